"""The event log: order, chain, streaks, breakers, budgets, windows, state moves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.operators import events as E
from quarry.operators.cluster import checkpoint_dir
from quarry.plans.registry import query, table
from quarry.sources import eventsource

ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS n FROM events WHERE event_type <> 'view') WHERE n > 3")
def event_sequence_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public events numbered, those after the third."""
    return E.numbered(_events(spark, sf_dir).where(F.col("event_type") != "view"), "user_id", ORDER, 3).select("user_id", "event_id", "n")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def last_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, P4."""
    return E.last_row(_events(spark, sf_dir), "user_id", ORDER).select("user_id", "event_id", "event_type")


@query("""WITH p AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), q AS (SELECT *, CASE WHEN event_id % 500 = 499 THEN -1 ELSE b END AS predecessor FROM p)
  SELECT user_id, bool_and(predecessor IS NOT DISTINCT FROM b) AS ok FROM q GROUP BY 1""")
def event_chain_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some links are broken on purpose."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = _events(spark, sf_dir).withColumn("predecessor", F.when(F.col("event_id") % 500 == 499, -1).otherwise(F.lag("event_id").over(w)))
    return E.chain_ok(e, "user_id", "event_id", "predecessor", ORDER)


STREAK_SQL = """
  i AS (SELECT *, event_type IN ('error', 'view') AS fail, sum(CASE WHEN event_type IN ('error', 'view') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
  st AS (SELECT *, sum(fail::INTEGER) OVER (PARTITION BY user_id, island ORDER BY ts, event_id)::BIGINT AS streak FROM i)
"""


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failure_streaks(_events(spark, sf_dir), "user_id", ORDER, F.col("event_type").isin("error", "view"))


@query(f"WITH {STREAK_SQL} SELECT event_id, streak FROM st")
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G13."""
    return _streaks(spark, sf_dir).select("event_id", "streak")


@query(f"""WITH {STREAK_SQL}, o AS (SELECT user_id, max((ts, event_id)) FILTER (streak >= 3 OR value > 99) AS o, max((ts, event_id)) FILTER (streak = 0 AND value <= 99) AS s, arg_max(ts, (ts, event_id)) FILTER (streak >= 3 OR value > 99) AS t FROM st GROUP BY 1)
  SELECT user_id, CASE WHEN o IS NOT NULL AND (s IS NULL OR s < o) THEN t + INTERVAL 4 HOUR END AS opened_until FROM o""")
def breaker_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three failures or a block open it for four hours; a later success shuts it."""
    return E.breaker(_streaks(spark, sf_dir), "user_id", ORDER, "ts", F.col("value") > 99)


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS used, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) > 2000 AS refused FROM events")
def budget_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 over one dimension: refused where the sum passes the ceiling."""
    rows = E.budget(_events(spark, sf_dir), "user_id", ORDER, "value", 2000.0)
    return rows.select("event_id", F.round("used", 2).alias("used"), (F.round("used", 2) > 2000).alias("refused"))


@query("SELECT event_id, CASE WHEN epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', ts)) > 21600 THEN 'UNKNOWN' ELSE event_type END AS availability FROM events")
def liveness_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13, P16."""
    e = _events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now)).select("event_id", S.present_availability(F.col("event_type"), F.col("ts"), F.col("now")).alias("availability"))


@query("SELECT event_id, (props->>'k')::INTEGER AS k, sha256('{\"k\":' || (props->>'k') || '}') AS digest FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: the payload read and named by its form."""
    k = F.get_json_object("props", "$.k")
    return _events(spark, sf_dir).select("event_id", k.cast("int").alias("k"), F.sha2(F.concat(F.lit('{"k":'), k, F.lit("}")), 256).alias("digest"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts."""
    return E.tumbling(_events(spark, sf_dir), "ts", "1 hour", F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events)
  SELECT event_id, f AS came_from, event_type FROM s WHERE f IS NOT NULL AND f <> event_type AND (f, event_type) NOT IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('purchase', 'view'), ('error', 'view'))""")
def illegal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17, P3, T4."""
    legal = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "view"), ("error", "view")]
    return E.illegal_moves(_events(spark, sf_dir), "user_id", "event_type", ORDER, legal).select("event_id", "came_from", "event_type")


@query("""WITH f AS (SELECT event_id % 700 AS k, event_id, value AS p, ts, CASE WHEN event_id % 90 = 7 THEN 'DONE' ELSE 'QUEUED' END AS st, event_id % 5 AS depth FROM events),
  e AS (SELECT DISTINCT k FROM f WHERE st = 'DONE'),
  q AS (SELECT k::VARCHAR AS work_key, p AS priority, ts AS created_at, row_number() OVER (PARTITION BY k ORDER BY p DESC, ts) AS n FROM f WHERE st = 'QUEUED' AND depth <= 3 AND k NOT IN (SELECT k FROM e))
  SELECT work_key, priority, created_at FROM q WHERE n = 1 ORDER BY priority DESC, created_at, work_key LIMIT 40""")
def frontier_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key once, none that ended, not too deep."""
    e = _events(spark, sf_dir)
    f = e.select((F.col("event_id") % 700).cast("string").alias("work_key"), F.col("value").alias("priority"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 90 == 7, "DONE").otherwise("QUEUED").alias("state"), (F.col("event_id") % 5).alias("depth"))
    return E.frontier_batch(f, 40).select("work_key", "priority", "created_at")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(60, greatest(0, value)) ELSE least(30, pow(2, greatest(0, event_id % 8 - 1))) END AS wait FROM events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, C39."""
    return _events(spark, sf_dir).select("event_id", S.backoff_seconds(F.col("event_id") % 8, F.when(F.col("event_id") % 3 == 0, F.col("value"))).alias("wait"))


@query("SELECT conv_id, turn, role, coalesce(lag(role) OVER w = role, false) AS repeats FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conversation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6, G7 over conversations."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce(F.lag("role").over(w) == F.col("role"), F.lit(False)).alias("repeats"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, epoch_us(max(ts)) AS last_us, round(sum(value), 2) AS total FROM events WHERE event_id > 150 GROUP BY 1")
def events_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through its own format, from an event id on."""
    eventsource.register(spark)
    rows = spark.read.format("quarry_events").option("path", f"{sf_dir}/events.parquet").option("after", 150).load()
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.unix_micros(F.max("ts")).alias("last_us"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT CASE WHEN event_id <= 400 THEN 1 ELSE 2 END AS run, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE event_id > 99 GROUP BY ALL")
def resumed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream from an event id that ends, and a second one that goes on after the last id that the first committed."""
    eventsource.register(spark)
    base = f"{checkpoint_dir(spark)}/resumed-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/runs/run={number + 1}")

    for options in ({"after": 99, "until": 400}, {}):
        rows = spark.readStream.format("quarry_events").options(path=f"{sf_dir}/events.parquet", **options).load()
        rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/runs")
    return out.groupBy("run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
