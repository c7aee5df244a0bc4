"""Intervals, gates, vetoes, buckets, ranks, query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.operators import metrics, ranking
from quarry.plans.registry import query, table

#: Candidates from orders and their lines: bounds and flags as plain columns.
CANDIDATE_SQL = """
  l AS (SELECT l_orderkey AS id, sum(l_discount) AS disc, count(*) AS images, max(l_tax) AS tax, count(DISTINCT l_suppkey) AS sellers, sum((l_returnflag = 'R')::INTEGER) AS returned FROM lineitem GROUP BY 1),
  cand AS (
    SELECT o_orderkey AS id, o_custkey AS family, o_orderstatus AS status, o_totalprice AS price, images, sellers,
           round(1 - disc / images * 1.1, 6) AS item_lower, round(1 - tax * 2.4, 6) AS auth_lower,
           round(least(1, 0.4 + 0.15 * images), 6) AS completeness, o_orderstatus <> 'F' AS live, returned > 1 AS scam
    FROM orders JOIN l ON id = o_orderkey)
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_discount").alias("disc"), F.count(F.lit(1)).alias("images"), F.max("l_tax").alias("tax"), F.count_distinct("l_suppkey").alias("sellers"), F.sum((F.col("l_returnflag") == "R").cast("int")).alias("returned"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    j = o.join(li, "id")
    return j.select(
        "id", "family", "status", "price", "images", "sellers", F.round(1 - F.col("disc") / F.col("images") * 1.1, 6).alias("item_lower"), F.round(1 - F.col("tax") * 2.4, 6).alias("auth_lower"),
        F.round(F.least(F.lit(1.0), 0.4 + 0.15 * F.col("images")), 6).alias("completeness"), (F.col("status") != "F").alias("live"), (F.col("returned") > 1).alias("scam"),
    )


VETO_SQL = "list_filter([CASE WHEN sellers >= 5 THEN 'stolen_photo' END, CASE WHEN price < 2000 THEN 'implausible_price' END, CASE WHEN NOT live THEN 'dead_listing' END], lambda x: x IS NOT NULL)"


def _vetoes(c: DataFrame) -> DataFrame:
    return c.withColumn("vetoes", S.hard_vetoes([("stolen_photo", F.col("sellers") >= 5), ("implausible_price", F.col("price") < 2000), ("dead_listing", ~F.col("live"))]))


@query(f"WITH {CANDIDATE_SQL} SELECT id, {VETO_SQL} AS vetoes FROM cand")
def hard_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11."""
    return _vetoes(candidates(spark, sf_dir)).select("id", "vetoes")


@query(f"""WITH {CANDIDATE_SQL}, v AS (SELECT *, len({VETO_SQL}) AS n FROM cand),
  g AS (SELECT *, item_lower >= 0.9 AND auth_lower >= 0.8 AND completeness >= 0.65 AND live AND NOT scam AND n = 0 AS is_real, item_lower >= 0.45 AND NOT scam AND n = 0 AS maybe FROM v)
  SELECT CASE WHEN family % 50 = 0 THEN 'HIDDEN' WHEN family % 49 = 0 THEN 'REPLICA' WHEN is_real THEN 'REAL' WHEN maybe THEN 'POSSIBLY_REAL' ELSE 'HIDDEN' END AS bucket, count(*) AS n, min(id) AS first_id FROM g GROUP BY 1""")
def route_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9, D10, D12, O1, O4, F7."""
    c = _vetoes(candidates(spark, sf_dir))
    zero = F.lit(0)
    real = S.real_gate(F.col("item_lower"), F.col("auth_lower"), F.col("completeness"), F.col("live"), F.lit(True), zero, F.col("scam"), F.col("vetoes"))
    maybe = S.possibly_gate(F.col("item_lower"), zero, zero, F.col("scam"), F.col("vetoes"))
    routed = c.withColumn("bucket", S.bucket(real, maybe, F.col("family") % 49 == 0, F.col("family") % 50 != 0))
    return routed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("""WITH s AS (SELECT user_id, avg(CASE WHEN event_type = 'purchase' THEN least(1, value / 100) END) AS sup, count(*) FILTER (event_type = 'error') AS con, count(*) FILTER (event_type = 'view') AS mis, count(*) FILTER (event_type = 'signup' AND value < 1) AS hard FROM events GROUP BY 1),
  m AS (SELECT user_id, con, mis, greatest(0, least(1, coalesce(sup, 0) - 0.12 * (con % 3) - 0.04 * (mis % 4) - 0.25 * least(hard, 1))) AS m, least(0.45, 0.08 + 0.05 * (mis % 4) + 0.04 * (con % 3)) AS s FROM s)
  SELECT user_id, round(m, 4) AS mean, round(greatest(0, m - s), 4) AS lower_bound, round(least(1, m + 0.6 * s), 4) AS upper_bound FROM m""")
def evidence_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """support averaged, contradictions, gaps and hard contradictions taken off."""
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    sums = e.groupBy("user_id").agg(F.avg(F.when(t == "purchase", F.least(F.lit(1.0), F.col("value") / 100))).alias("sup"), F.count_if(t == "error").alias("con"), F.count_if(t == "view").alias("mis"), F.count_if((t == "signup") & (F.col("value") < 1)).alias("hard"))
    iv = S.evidence_interval(F.col("sup"), F.col("con") % 3, F.col("mis") % 4, F.least(F.col("hard"), F.lit(1)))
    # four digits: engines differ in how they round the seventh
    return sums.select("user_id", iv.alias("i")).select("user_id", *(F.round(f"i.{c}", 4).alias(c) for c in ("mean", "lower_bound", "upper_bound")))


@query(f"""WITH {CANDIDATE_SQL}, x AS (SELECT id, greatest(0, item_lower) * 0.97713 AS t, greatest(0, auth_lower) * 0.97739 AS v, completeness AS p, (sellers >= 6)::INTEGER AS hard, 5 - least(images, 5) AS missing FROM cand),
  m AS (SELECT id, hard, missing, p, v, 0.18*t + 0.18*v + 0.30*p + 0.16*0.95 + 0.08*0.7 + 0.10*0.8 AS m, 0.18*(t - 0.031) + 0.18*v*0.91 + 0.30*(p - 0.06) + 0.16*0.88 + 0.08*0.55 + 0.10*0.7 AS low, 0.04 + 0.03 * least(4, missing) AS s FROM x),
  b AS (SELECT id, hard, m, least(m, least(1, greatest(0, least(m, low) - 0.15 * s))) AS lo, greatest(m, least(1, greatest(m, 0.55) + 0.04)) AS hi, hard = 0 AND p >= 0.9 AND v >= 0.88 AND missing <= 2 AS strong FROM m),
  c AS (SELECT id, hard, m, CASE WHEN strong THEN least(m, greatest(lo, 0.91)) ELSE lo END AS lo, hi FROM b)
  SELECT id, round(round(CASE WHEN hard > 0 THEN least(m, 0.22) ELSE m END, 6), 4) AS mean, round(round(CASE WHEN hard > 0 THEN least(lo, 0.12) ELSE lo END, 6), 4) AS lower_bound, round(round(CASE WHEN hard > 0 THEN least(hi, greatest(least(m, 0.22), 0.35)) ELSE hi END, 6), 4) AS upper_bound FROM c""")
def item_match_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower bound comes from the parts' own lower bounds."""
    c = candidates(spark, sf_dir)
    part = lambda mean, low: F.struct(mean.alias("mean"), low.alias("lower_bound"), F.lit(1.0).alias("upper_bound"))
    t, v = F.greatest(F.lit(0.0), "item_lower") * 0.97713, F.greatest(F.lit(0.0), "auth_lower") * 0.97739
    iv = S.item_match(part(t, t - 0.031), part(v, v * 0.91), F.col("completeness"), part(F.lit(0.95), F.lit(0.88)), part(F.lit(0.7), F.lit(0.55)), part(F.lit(0.8), F.lit(0.7)), (F.col("sellers") >= 6).cast("int"), 5 - F.least(F.col("images"), F.lit(5)), F.lit(False))
    # four digits: engines differ in how they round the seventh
    return c.select("id", iv.alias("i")).select("id", *(F.round(f"i.{x}", 4).alias(x) for x in ("mean", "lower_bound", "upper_bound")))


@query(f"""WITH {CANDIDATE_SQL}, r AS (SELECT id, status, family, row_number() OVER (PARTITION BY status ORDER BY item_lower DESC, auth_lower DESC, completeness DESC, live DESC, id)::INTEGER AS rank FROM cand),
  n AS (SELECT *, row_number() OVER (PARTITION BY status, family ORDER BY rank) > 1 AS again FROM r),
  p AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY again, rank)::INTEGER AS place FROM n)
  SELECT id, status, rank, place FROM p WHERE place <= 100""")
def rank_and_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred places of each tab."""
    keys = [F.col(c) for c in ("item_lower", "auth_lower", "completeness", "live")]
    ranked = ranking.rank_tab(candidates(spark, sf_dir).select("id", "status", "family", *keys), "status", keys, "id")
    return ranking.diversify(ranked, "status", "family").select("id", "status", "rank", "place").where(F.col("place") <= 100)


@query("""WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rank FROM orders)
  SELECT o_orderkey, rank, CASE WHEN rank <= 10 THEN 'deep' WHEN rank <= 15 THEN 'deliberative' WHEN rank <= 50 THEN 'parts' WHEN rank <= 100 THEN 'download' WHEN rank <= 250 THEN 'normalised' ELSE 'broad' END AS stage FROM t WHERE rank <= 500""")
def escalation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12, H4."""
    return ranking.cascade(table(spark, sf_dir, "orders"), F.col("o_totalprice"), "o_orderkey").select("o_orderkey", "rank", "stage")


@query("""WITH q AS (SELECT 1 AS search, p_brand AS family, p_size % 6 AS round, round_even((p_retailprice / 2500) * (1 - (p_size % 10) / 10) * (0.4 + least(1, 0.25 * (p_partkey % 5))) / (1 + (p_size % 3)), 4) AS gain, p_size % 3 AS cost, p_partkey::VARCHAR AS text FROM part),
  b AS (SELECT round, max(gain) AS g FROM q GROUP BY 1),
  k AS (SELECT round, min((g >= [0, 0.04, 0.06, 0.08, 0.10, 0.12][round + 1])::INTEGER) OVER (ORDER BY round) AS ok FROM b),
  n AS (SELECT q.*, row_number() OVER (PARTITION BY family ORDER BY gain DESC, cost, text) AS f, row_number() OVER (PARTITION BY q.round ORDER BY gain DESC, cost, text) AS r FROM q JOIN k ON k.round = q.round AND ok = 1),
  p AS (SELECT *, row_number() OVER (ORDER BY gain DESC, cost, text)::INTEGER AS position FROM n WHERE f <= 8 AND r <= 16)
  SELECT text, family, round, gain, position FROM p WHERE position <= 48""")
def query_plan_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, G4, L3, L5, H6."""
    p = table(spark, sf_dir, "part")
    gain = S.information_gain(F.col("p_retailprice") / 2500, F.lit(1.0), (F.col("p_size") % 10) / 10, F.col("p_partkey") % 5, F.col("p_size") % 3)
    q = p.select(F.lit(1).alias("search"), F.col("p_brand").alias("family"), (F.col("p_size") % 6).alias("round"), gain.alias("gain"), (F.col("p_size") % 3).alias("cost"), F.col("p_partkey").cast("string").alias("text"))
    return ranking.select_queries(q, "search").select("text", "family", "round", "gain", "position")


@query("""WITH h AS (SELECT p_brand AS search, p_partkey AS id, p_retailprice / 20000 AS posterior, p_size % 5 = 0 AS b, p_size % 7 = 0 AS y FROM part),
  a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY search ORDER BY posterior DESC, id) <= 8 AND posterior >= 0.03 THEN 'ACTIVE' ELSE 'ARCHIVED' END AS st FROM h),
  c AS (SELECT search, id, greatest(0.01, posterior * (CASE WHEN b THEN 0.7 ELSE 1.0 END * CASE WHEN y THEN 0.65 ELSE 1.0 END)) AS p, st FROM a),
  d AS (SELECT search, id, p, CASE WHEN p < 0.04 THEN 'ARCHIVED' ELSE st END AS status FROM c),
  w AS (SELECT *, sum(CASE WHEN status = 'ACTIVE' THEN p END) OVER (PARTITION BY search) AS w FROM d)
  SELECT search, id, status, CASE WHEN status = 'ACTIVE' AND w > 0 THEN round_even(p / w, 4) ELSE floor(p * 1000000 + 0.01) / 1000000 END AS posterior FROM w""")
def hypotheses_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G10, L9, F31."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 20000).alias("posterior"), (F.col("p_size") % 5 == 0).alias("brand_contradicted"), (F.col("p_size") % 7 == 0).alias("year_contradicted"))
    rows = ranking.contradicted(ranking.archive_weak(p, "search"), "search")
    return rows.select("search", "id", "status", F.when(F.col("status") == "ACTIVE", F.col("posterior")).otherwise(F.floor(F.col("posterior") * 1000000 + 0.01) / 1000000).alias("posterior"))


@query(f"""WITH {CANDIDATE_SQL} SELECT id, round(0.45 * live::INTEGER + 0.15 * coalesce(nullif((family % 3) / 2, 0), 0.5) + 0.1 * 0.5 + 0.1 * least(1, images / 4) + 0.1 * CASE WHEN price > 100000 THEN 0.6 ELSE 0.25 END + 0.1 * (family % 2 = 0)::INTEGER, 6) AS utility FROM cand""")
def listing_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: a match of zero counts as unknown."""
    u = S.utility(F.col("live"), (F.col("family") % 3) / 2, F.lit(None).cast("double"), F.col("images"), F.col("price") > 100000, F.col("family") % 2 == 0)
    return candidates(spark, sf_dir).select("id", F.round(u, 6).alias("utility"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN (p_size % 10) / 10 END AS a, CASE WHEN p_size % 3 <> 0 THEN (p_partkey % 10) / 10 END AS b, (p_size % 11) / 10 AS c, (p_size = 13)::INTEGER AS hard FROM part),
  m AS (SELECT p_partkey, hard, c, (coalesce(0.24 * a, 0) + coalesce(0.16 * b, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.24 END + CASE WHEN b IS NULL THEN 0 ELSE 0.16 END, 0) AS w FROM s),
  n AS (SELECT p_partkey, hard, CASE WHEN hard = 0 AND c >= 0.65 THEN least(1, coalesce(w, 0.5) + 0.12) ELSE coalesce(w, 0.5) END AS x FROM m)
  SELECT p_partkey, round(CASE WHEN hard > 0 THEN least(greatest(0, least(1, x)), 0.22) ELSE greatest(0, least(1, x)) END, 6) AS mean FROM n""")
def authenticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights over the parts that are established."""
    a, b = F.when(F.col("p_size") % 4 != 0, (F.col("p_size") % 10) / 10), F.when(F.col("p_size") % 3 != 0, (F.col("p_partkey") % 10) / 10)
    m = S.authenticity_mean({"construction": a, "label": b}, (F.col("p_size") == 13).cast("int"), (F.col("p_size") % 11) / 10, F.lit(0.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(m, 6).alias("mean"))


CALIBRATION = [(0.0, 0.2, 0.1, 0.2), (0.2, 0.4, 0.3, 0.18), (0.4, 0.6, 0.45, 0.15), (0.6, 0.8, 0.7, 0.12)]


@query("""WITH b(lo, hi, cal_mean, spread) AS (VALUES (0.0, 0.2, 0.1, 0.2), (0.2, 0.4, 0.3, 0.18), (0.4, 0.6, 0.45, 0.15), (0.6, 0.8, 0.7, 0.12)),
  r AS (SELECT p_partkey, (p_size % 10) / 10 AS raw FROM part)
  SELECT p_partkey, coalesce(cal_mean, raw)::DOUBLE AS cal_mean, coalesce(spread, 0.16)::DOUBLE AS spread, lo IS NOT NULL AS calibrated FROM r LEFT JOIN b ON raw >= lo::DOUBLE AND raw < hi::DOUBLE""")
def calibration_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins closed below, open above."""
    r = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") % 10) / 10).alias("raw"))
    return metrics.calibrated(r, "raw", CALIBRATION).select("p_partkey", "cal_mean", "spread", "calibrated")


@query("""SELECT user_id % 97 AS alias, count(DISTINCT CASE WHEN value >= 40 THEN event_type END) AS families, max((event_type = 'purchase' AND value >= 60)::INTEGER) AS authority, 0 AS improved FROM events GROUP BY 1
  HAVING count(DISTINCT CASE WHEN value >= 40 THEN event_type END) >= 2 OR max((event_type = 'purchase' AND value >= 60)::INTEGER) = 1""")
def promoted_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25, F26."""
    e = table(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 97).alias("alias"), (F.col("value") / 100).alias("confidence"), F.col("event_type").alias("family"), (F.col("event_type") == "purchase").alias("high_authority"), F.lit(False).alias("improved"), F.lit(False).alias("verified"))
    return ranking.promoted_aliases(rows, "alias")


@query("""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders ORDER BY 2 LIMIT 5),
  lanes AS (SELECT id, 0 AS lane, pos FROM a UNION ALL SELECT o_orderkey, 1, o_orderkey FROM orders),
  f AS (SELECT id, min(lane * 1000000000 + pos) AS f FROM lanes GROUP BY 1)
  SELECT id, (f // 1000000000)::INTEGER AS lane, f % 1000000000 AS at FROM f ORDER BY f, id LIMIT 8""")
def kept_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked ids first, then in order of discovery."""
    o = table(spark, sf_dir, "orders")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)
    from pyspark.sql import Window

    ranked = top.select(F.col("o_orderkey").alias("id"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("at"))
    return ranking.kept_ids(ranked, o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("at")), "id", "at")
