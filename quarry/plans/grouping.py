"""Clusters, photograph reuse, independence, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import url as U
from quarry.operators import cluster
from quarry.plans.listings import CANONICAL_SQL
from quarry.plans.registry import query, table

#: Titles of pages as classes of equal word sets, and pairs of classes by their smallest pages.
TITLE_SQL = """
  tw AS (SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[A-Za-z0-9぀-ヿ一-鿿가-힯]+'), lambda x: lower(x)))) AS w FROM pages),
  tc AS (SELECT w, min(page_id) AS head FROM tw WHERE len(w) > 0 GROUP BY 1),
  pairs AS (SELECT a.head AS a, b.head AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS similarity FROM tc a JOIN tc b ON a.head < b.head)
"""


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as listings: key by host and listing id, the advertisement as the image family."""
    p, u = table(spark, sf_dir, "pages"), F.col("url")
    ad = F.nullif(F.regexp_extract("html", r"(?is)<div class=\"ad\">(.*?)</div>", 1), F.lit(""))
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return p.select(F.col("page_id").alias("id"), cluster.cluster_key(U.host(u), U.listing_id(u), U.canonical_url(u)).alias("key"), F.sha2(ad, 256).alias("family"), U.listing_id(u).alias("listing"), title.alias("title"))


LISTING_SQL = f"""{CANONICAL_SQL},
  li AS (SELECT page_id AS id, CASE WHEN regexp_matches(url, '[?&]id=[0-9]+') THEN regexp_extract(url, '[?&]id=([0-9]+)', 1) END AS listing, CASE WHEN regexp_matches(url, '[?&]id=[0-9]+') THEN host || ':' || regexp_extract(url, '[?&]id=([0-9]+)', 1) ELSE 'url:' || canonical_url END AS key,
    nullif(regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1), '') AS family, w FROM canon JOIN pages USING (page_id, url) JOIN tw USING (page_id)),
  ed AS (SELECT a.id AS a, b.id AS b FROM li a JOIN li b ON a.id <> b.id AND (a.key = b.key OR ((a.listing IS NULL OR b.listing IS NULL OR a.listing = b.listing) AND (a.family = b.family OR (len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.9)))))
"""


@query(f"WITH {TITLE_SQL} SELECT tc.head, count(*) AS members, (SELECT count(*) FROM pairs WHERE similarity >= 0.9 AND tc.head IN (a, b)) AS links FROM tw JOIN tc USING (w) GROUP BY ALL")
def near_dup_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of titles with their members and how many other classes are near, met on rare words only."""
    pairs, members = cluster.near_title_pairs(_listings(spark, sf_dir), "id", "title", 0.9)
    ends = pairs.select(F.col("a").alias("head")).unionByName(pairs.select(F.col("b").alias("head"))).groupBy("head").agg(F.count(F.lit(1)).alias("links"))
    return members.groupBy("head").agg(F.count(F.lit(1)).alias("members")).join(ends, "head", "left").select("head", "members", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query(f"""WITH RECURSIVE {TITLE_SQL}, {LISTING_SQL},
  reach AS (SELECT page_id AS node, page_id AS seen FROM pages UNION SELECT r.node, e.b FROM reach r JOIN ed e ON e.a = r.seen)
  SELECT node AS id, min(seen) AS cluster FROM reach GROUP BY 1""")
def cluster_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2, K3: pages as listings by key, image family and title, as connected components; different listings part."""
    return cluster.cluster_listings(_listings(spark, sf_dir), 0.9)


@query(f"""WITH RECURSIVE {TITLE_SQL}, {LISTING_SQL},
  reach AS (SELECT page_id AS node, page_id AS seen FROM pages UNION SELECT r.node, e.b FROM reach r JOIN ed e ON e.a = r.seen),
  c AS (SELECT node AS id, min(seen) AS cluster FROM reach GROUP BY 1)
  SELECT count(*) AS candidates, (SELECT count(DISTINCT key) FROM li) AS keys, count(DISTINCT cluster) AS clusters, count(*) - count(DISTINCT cluster) AS removed, round((count(*) - count(DISTINCT cluster)) / count(*), 6) AS share FROM c""")
def cluster_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what clustering saves."""
    rows = _listings(spark, sf_dir)
    return cluster.savings(rows, cluster.cluster_listings(rows, 0.9))


@query("""WITH RECURSIVE f AS (SELECT text AS d, min(conv_id) AS head FROM conversations GROUP BY 1),
  ed AS (SELECT DISTINCT conv_id AS a, head AS b FROM conversations c JOIN f ON f.d = c.text WHERE conv_id <> head),
  both_ways AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
  reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
  SELECT c.conv_id AS node, coalesce(min(seen), c.conv_id) AS component FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN reach r ON r.node = c.conv_id GROUP BY c.conv_id""")
def render_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: cases (conversations) that share the digest of a whole turn, as components."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.sha2("text", 256).alias("digest"))
    heads = rows.groupBy("digest").agg(F.min("conv_id").alias("b"))
    linked = cluster.components(rows.join(heads, "digest").select(F.col("conv_id").alias("a"), "b"))
    return rows.select(F.col("conv_id").alias("node")).distinct().join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query("SELECT l_partkey AS family, count(DISTINCT l_suppkey) AS sellers, count(DISTINCT l_suppkey) >= 2 AS reused, count(DISTINCT l_suppkey) >= 3 AS stock_photo FROM lineitem GROUP BY 1")
def photo_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, E15, N29."""
    return cluster.photo_reuse(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT l_orderkey AS record, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN sha256(l_partkey::VARCHAR) ELSE l_returnflag END) AS families FROM lineitem GROUP BY 1")
def independent_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evidence of one family counts once."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("family"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("digest"))
    return cluster.independent_families(rows, "record", "family", "digest")


@query("""WITH c AS (SELECT text, lang, source, doc_id, length(text) AS n FROM documents)
  SELECT lang, sha256(text) AS digest, count(*) AS members, arg_max(doc_id, (source, doc_id)) AS representative FROM c GROUP BY lang, text""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best member of each group without a sort."""
    d = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("digest"), "source", "doc_id")
    d = d.withColumn("c", F.struct("lang", "digest"))
    return cluster.representatives(d, "c", ["source"], "doc_id").select("c.lang", "c.digest", "members", "representative")


@query("""WITH d AS (SELECT DISTINCT doc_id, sha256(trim(l)) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''),
  b AS (SELECT DISTINCT item_id, sha256(trim(l)) AS digest FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS l FROM benchmark) WHERE trim(l) <> '')
  SELECT digest, count(DISTINCT doc_id) AS documents, count(DISTINCT item_id) AS items FROM d JOIN b USING (digest) GROUP BY 1""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are in both splits, met by digest; counted on each side before they meet."""

    def lines(name: str, key: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(key, F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l") != "")
        return rows.select(key, F.sha2(F.trim("l"), 256).alias("digest")).groupBy("digest").agg(F.count_distinct(key).alias("documents" if name == "documents" else "items"))

    return lines("documents", "doc_id").join(lines("benchmark", "item_id"), "digest")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.03)")
def not_attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned but not run, as an anti join."""
    run = table(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.03)).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(run, "p_partkey", "left_anti")
