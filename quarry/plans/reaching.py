"""Reach strategies and path rules over nations as sources, parts as queries and pages as URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import reach
from quarry.plans.registry import query, spread, table

PLANNED_SQL = r"""
  src AS (
    SELECT n_nationkey AS k, lower(n_name) AS source_id, 'https://n' || n_nationkey || '.example' AS o1,
      CASE WHEN n_nationkey % 3 = 0 THEN 'https://b' || n_nationkey || '.example' END AS o2 FROM nation),
  ask AS (
    SELECT p_partkey AS query_id, src.*, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name END AS text,
      lower(replace(array_to_string(list_slice(string_split(p_name, ' '), 1, 2), ' '), ' ', '-')) AS slug, replace(p_name, ' ', '+') AS quoted
    FROM part JOIN src ON src.k = p_partkey % 25),
  five AS (
    SELECT query_id, source_id, 'collection_slug' AS strategy,
      CASE WHEN text = '' OR k % 4 NOT IN (0, 2) THEN 'skipped' WHEN k % 5 = 2 AND slug NOT LIKE 'b%' THEN 'blocked' ELSE 'queued' END AS status,
      CASE WHEN text = '' THEN 'no query text from which to derive a collection handle' WHEN k % 4 NOT IN (0, 2) THEN 'no collection handle could be derived from the query'
        WHEN k % 5 = 2 AND slug NOT LIKE 'b%' THEN 'recorded disallowed path prefix' ELSE 'guessed collection handle from the query' END AS reason,
      CASE WHEN text = '' OR k % 4 NOT IN (0, 2) THEN '' ELSE concat_ws(' ', o1 || '/collections/' || slug || CASE WHEN k % 4 = 0 THEN '.json' ELSE '' END, o2 || '/collections/' || slug || CASE WHEN k % 4 = 0 THEN '.json' ELSE '' END) END AS urls
    FROM ask
    UNION ALL
    SELECT query_id, source_id, 'site_search',
      CASE WHEN k % 7 = 0 OR text = '' OR k % 4 > 1 THEN 'skipped' WHEN k % 3 = 1 THEN 'blocked' ELSE 'queued' END,
      CASE WHEN k % 7 = 0 THEN 'search is not an admitted use of ' || source_id WHEN text = '' THEN 'no query text' WHEN k % 4 > 1 THEN source_id || ' publishes no admitted site-search path'
        WHEN k % 3 = 1 THEN 'robots Disallow: /search' ELSE 'admitted site search' END,
      CASE WHEN k % 7 = 0 OR text = '' OR k % 4 > 1 THEN '' ELSE o1 || '/search?q=' || quoted END
    FROM ask
    UNION ALL
    SELECT query_id, source_id, 'catalog_feed',
      CASE WHEN k % 5 = 0 OR text = '' THEN 'skipped' WHEN k % 11 = 4 OR k % 7 = 3 THEN 'blocked' ELSE 'queued' END,
      CASE WHEN k % 5 = 0 THEN source_id || ' publishes no catalogue feed' WHEN text = '' THEN 'no query text to match against the catalogue feed'
        WHEN k % 11 = 4 THEN 'robots Disallow: /search' WHEN k % 7 = 3 THEN 'recorded disallowed path prefix' ELSE 'shop-wide product feed, independent of collection handles' END,
      CASE WHEN k % 5 = 0 OR text = '' THEN '' ELSE concat_ws(' ', o1 || CASE WHEN k % 11 = 4 THEN '/search/all.json' ELSE '/products.json' END || '?limit=50&page=1', o2 || CASE WHEN k % 11 = 4 THEN '/search/all.json' ELSE '/products.json' END || '?limit=50&page=1') END
    FROM ask
    UNION ALL
    SELECT query_id, source_id, 'sitemap', CASE WHEN k % 6 = 0 THEN 'skipped' WHEN k % 9 = 4 THEN 'blocked' ELSE 'queued' END,
      CASE WHEN k % 6 = 0 THEN source_id || ' declares no sitemap' WHEN k % 9 = 4 THEN 'recorded disallowed path prefix' ELSE 'robots-allowed sitemap' END,
      CASE WHEN k % 6 = 0 THEN '' ELSE o1 || '/sitemap.xml' END
    FROM ask
    UNION ALL
    SELECT query_id, source_id, 'official_api', 'skipped',
      CASE k % 8 WHEN 0 THEN 'missing A and B. Create Shop credentials at https://x.example/keys' WHEN 1 THEN 'missing A, B, and C. Create Shop credentials at https://x.example/keys'
        WHEN 2 THEN 'Shop credentials are set but the official API client is not implemented. Docs: https://x.example/keys' ELSE source_id || ' publishes no official API' END, ''
    FROM ask)
"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("n_nationkey"), F.lit(None)
    key = k.cast("string")
    first, second = F.concat(F.lit("https://n"), key, F.lit(".example")), F.concat(F.lit("https://b"), key, F.lit(".example"))
    collection, search = F.when(k % 4 == 0, "/collections/{slug}.json").when(k % 4 == 2, "/collections/{slug}"), F.when(k % 4 <= 1, "/search?q={query}")
    blank, given = F.lit(""), F.lit("x")
    keys = F.when(k % 8 == 0, F.create_map(F.lit("B"), blank, F.lit("A"), F.lit(" "))).when(k % 8 == 1, F.create_map(F.lit("A"), blank, F.lit("C"), blank, F.lit("B"), blank)).when(k % 8 == 2, F.create_map(F.lit("A"), given))
    nation = table(spark, sf_dir, "nation")
    sources = nation.select(
        F.lower("n_name").alias("source_id"), F.array_compact(F.array(first, F.when(k % 3 == 0, second))).alias("origins"), F.array_compact(F.array(collection, search)).alias("query_paths"),
        F.when(k % 6 != 0, F.array(F.concat(first, F.lit("/sitemap.xml")))).alias("sitemaps"), F.when(k % 5 == 0, none.cast("string")).when(k % 11 == 4, "search/all.json").otherwise("/products.json").alias("feed_path"),
        F.lit(50).alias("page_size"), (k % 7 != 0).alias("may_search"), F.lit("Shop").alias("product"), F.lit("https://x.example/keys").alias("signup_url"), keys.alias("keys"),
    )
    rule = lambda when, prefix, allow: F.when(when, F.struct(F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow")))
    stated = F.array_compact(F.array(rule(k % 3 == 1, "/search", False), rule(k % 5 == 2, "/collections", False), rule(k % 5 == 2, "/collections/b", True), rule(k % 7 == 3, "/products", False), rule(k % 9 == 4, "/sitemap*", False), rule(k % 2 == 0, "/p", True)))
    rules = nation.select(F.lower("n_name").alias("source_id"), F.inline(stated))
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    p = parts.select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") % 25).alias("k"), F.when(F.col("p_size") % 9 == 0, "  ").otherwise(F.col("p_name")).alias("text"))
    asked = p.join(F.broadcast(nation.select(F.col("n_nationkey").cast("long").alias("k"), F.lower("n_name").alias("source_id"))), "k").drop("k")  # 25 nations
    return reach.plan(asked, sources, rules)


@query(f"WITH {PLANNED_SQL} SELECT * FROM five")
def reach_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five strategies for every part at its nation, with what is queued, blocked or skipped and why."""
    return _planned(spark, sf_dir).withColumn("urls", F.array_join("urls", " "))


@query(f"WITH {PLANNED_SQL} SELECT source_id, strategy, count(*) AS urls FROM (SELECT source_id, strategy, unnest(string_split(urls, ' ')) AS url FROM five WHERE status = 'queued' AND strategy <> 'catalog_feed') GROUP BY ALL")
def reach_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the frontier begins, by source and strategy."""
    return reach.seeds(_planned(spark, sf_dir)).groupBy("source_id", "strategy").agg(F.count(F.lit(1)).alias("urls"))


@query(r"""WITH r(prefix, allow) AS (VALUES ('/item', false), ('/item/1', true), ('/item/12', false), ('/', true), ('/p', false), ('/p/9', true)),
  u AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(\?[^#]+)', 1) AS q FROM pages),
  t AS (SELECT page_id, CASE WHEN path = '' THEN '/' ELSE path END || q AS target FROM u),
  m AS (SELECT t.page_id, arg_max(prefix, length(prefix)) AS prefix, arg_max(allow, length(prefix)) AS allow FROM t LEFT JOIN r ON starts_with(t.target, r.prefix) GROUP BY 1)
  SELECT page_id, prefix, coalesce(allow, true) AS allowed FROM m""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule that begins the path of each page's URL."""
    rules = spark.createDataFrame([("x", p, a) for p, a in (("/item", False), ("/item/1", True), ("/item/12*", False), ("/", True), ("/p", False), ("/p/9", True))], "source_id string, prefix string, allow boolean")
    urls = table(spark, sf_dir, "pages").select("page_id", F.lit("x").alias("source_id"), "url")
    return reach.ruled(urls, rules).select("page_id", "prefix", "allowed")
