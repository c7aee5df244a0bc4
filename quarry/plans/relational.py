"""Joins, aggregates and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.registry import query, table


@query("""SELECT n_name, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_custkey) AS customers
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_shipdate >= DATE '1996-01-01' GROUP BY 1""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").where(F.col("l_shipdate") >= "1996-01-01").select("l_orderkey", "l_suppkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    j = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name"), F.col("s_suppkey") == F.col("l_suppkey"))
    return j.groupBy("n_name").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("r"), 2).alias("revenue"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(avg(l_extendedprice), 4) AS price, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= "1998-09-02")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)")
def priority_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 over two levels."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).rollup("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def customers_without_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I6 as a set difference."""
    opened = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "O").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(opened)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def hidden_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the three most frequent codes."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("SELECT o_custkey AS source, sum((o_orderstatus = 'F')::INTEGER)::BIGINT AS completed, sum((o_orderstatus = 'P')::INTEGER)::BIGINT AS blocked, list_sort(list_distinct(list(o_orderpriority))) AS families FROM orders GROUP BY 1")
def coverage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F23, F24, F22, O5."""
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count_if(s == "F").alias("completed"), F.count_if(s == "P").alias("blocked"), F.sort_array(F.collect_set("o_orderpriority")).alias("families"))


@query("""WITH a AS (SELECT l_orderkey AS k, 'quantity' AS field, sum(l_quantity) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 'lines', count(*) FROM lineitem GROUP BY 1),
  b AS (SELECT o_orderkey AS k, 'quantity' AS field, o_orderkey % 200 AS v FROM orders UNION ALL SELECT o_orderkey, 'lines', o_orderkey % 7 FROM orders)
  SELECT b.k, b.field, CASE WHEN a.v IS NULL THEN 'missing' WHEN a.v = b.v THEN 'support' ELSE 'contradiction' END AS verdict FROM b LEFT JOIN a ON a.k = b.k AND a.field = b.field""")
def verification_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded and observed fields, unpivoted and joined by field."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines")).unpivot("k", ["quantity", "lines"], "field", "seen")
    told = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 200).alias("quantity"), (F.col("o_orderkey") % 7).alias("lines")).unpivot("k", ["quantity", "lines"], "field", "told")
    j = told.join(seen, ["k", "field"], "left")
    return j.select("k", "field", F.when(F.col("seen").isNull(), "missing").when(F.col("seen") == F.col("told"), "support").otherwise("contradiction").alias("verdict"))
