"""Tokens, postings, text, vector and hybrid search, catalogue matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import index
from quarry.plans.registry import query, table

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)
#: Tokens of documents: tok(doc_id, term), a row for each occurrence, with years in both lengths.
TOKENS_SQL = f"""
  raw AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM documents),
  base AS (SELECT * FROM raw WHERE length(t) > 1 AND t NOT IN ({STOP_SQL})),
  tok AS (
    SELECT doc_id, t AS term FROM base
    UNION ALL SELECT doc_id, '20' || t FROM base WHERE regexp_full_match(t, '[0-9][0-9]') AND t <= '30'
    UNION ALL SELECT doc_id, substr(t, 3, 2) FROM base WHERE length(t) = 4 AND t LIKE '20%')
"""
#: Queries are all rows whose id can be divided by 20: benchmark items for text, vectors for descriptors.
ASKED_SQL = f"""
  qraw AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark WHERE item_id % 20 = 0),
  qbase AS (SELECT * FROM qraw WHERE length(t) > 1 AND t NOT IN ({STOP_SQL})),
  asked AS (SELECT item_id AS query_id, t AS term FROM qbase UNION SELECT item_id, '20' || t FROM qbase WHERE regexp_full_match(t, '[0-9][0-9]') AND t <= '30' UNION SELECT item_id, substr(t, 3, 2) FROM qbase WHERE length(t) = 4 AND t LIKE '20%'),
  tscore AS (SELECT query_id, doc_id AS listing_key, count(*) AS term_score FROM asked JOIN tok USING (term) GROUP BY ALL),
  txt AS (SELECT * FROM tscore QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY term_score DESC, listing_key) <= 50)
"""
VECTOR_SQL = """
  e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  vec AS (SELECT a.vec_id AS query_id, b.vec_id AS listing_key, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS descriptor_score FROM e a, e b WHERE a.vec_id % 20 = 0),
  hits AS (SELECT * FROM vec WHERE descriptor_score >= 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY descriptor_score DESC, listing_key) <= 50)
"""


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(table(spark, sf_dir, "documents"), "doc_id", {"text": "text"})


def _text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only tokens that some query asks for are counted: a filter before the shuffle, on a few thousand terms a thousand queries."""
    asked = T.token_rows(table(spark, sf_dir, "benchmark").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "text"), ["query_id"], "text").distinct()
    rows = T.token_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("listing_key"), "text"), ["listing_key"], "text")
    posted = rows.join(asked.select("term").distinct(), "term", "left_semi").groupBy("listing_key", "term").agg(F.count(F.lit(1)).alias("tf"))
    return index.text_search(posted, asked)


def _vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return index.vector_search(e.where(F.col("vec_id") % 20 == 0), e, "vec_id", "embedding")


@query(f"WITH {TOKENS_SQL} SELECT doc_id AS listing_key, 'text' AS field, term, count(*) AS tf FROM tok GROUP BY ALL")
def postings_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of all documents."""
    return _postings(spark, sf_dir)


@query(f"WITH {TOKENS_SQL}, {ASKED_SQL} SELECT * FROM txt")
def text_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents for every benchmark item that asks."""
    return _text_hits(spark, sf_dir)


@query(f"WITH {VECTOR_SQL} SELECT * FROM hits")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine top 50 of every vector that asks, negatives left out."""
    return _vector_hits(spark, sf_dir)


@query(f"""WITH {TOKENS_SQL},
  b AS (SELECT doc_id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS bucket FROM tok),
  c AS (SELECT doc_id, bucket, count(*) AS n FROM b GROUP BY ALL),
  z AS (SELECT doc_id, sqrt(sum(n * n)) AS z FROM c GROUP BY 1)
  SELECT c.doc_id, bucket::INTEGER AS bucket, round(n / z, 6) AS weight FROM c JOIN z USING (doc_id)""")
def hashed_text_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, as rows: a count for each bucket over the text's norm."""
    docs = table(spark, sf_dir, "documents")
    rows = T.token_rows(docs, ["doc_id"], "text").select("doc_id", V.term_bucket(F.col("term")).alias("bucket"))
    counts = rows.groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "n")).alias("b"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("z"))
    return whole.select("doc_id", "z", F.inline("b")).select("doc_id", "bucket", F.round(F.col("n") / F.col("z"), 6).alias("weight"))


@query("""SELECT item_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9぀-ヿ一-鿿가-힯]+'), lambda x: lower(x)))) AS words FROM benchmark""")
def title_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(T.title_tokens(F.col("text"))).alias("words"))


@query(f"""WITH {TOKENS_SQL},
  d AS (SELECT DISTINCT doc_id, term FROM tok), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
  braw AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
  q AS (SELECT DISTINCT item_id, t AS term FROM braw WHERE length(t) > 1 AND t NOT IN ({STOP_SQL})),
  m AS (SELECT item_id, count(*) AS m FROM q GROUP BY 1),
  o AS (SELECT item_id, doc_id, count(*) AS k FROM q JOIN d USING (term) GROUP BY ALL)
  SELECT item_id, doc_id, round(k / least(n, m), 6) AS containment, round(0.55 * (k / (n + m - k)) + 0.45 * (k / least(n, m)), 6) AS identity
  FROM o JOIN n USING (doc_id) JOIN m USING (item_id) WHERE k >= 0.9 * m AND m > 5""")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items nearly all of whose terms a document holds.

    Of m terms a document must hold 0.9 m, so it holds one of the m - ceil(0.9 m) + 1 rarest: documents and items meet
    on those, then their sets are compared.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("have"))
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("terms")).where(F.size("terms") > 5)
    asked = q.select("item_id", F.explode("terms").alias("term"))
    each = T.token_rows(table(spark, sf_dir, "documents"), ["doc_id"], "text").join(asked.select("term").distinct(), "term", "left_semi").distinct()
    held = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = asked.join(held, "term", "left").withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "term")))
    m = F.size("terms")
    rare = ranked.join(q, "item_id").where(F.col("n") <= m - F.ceil(0.9 * m) + 1).select("item_id", "term")
    pairs = each.join(rare, "term").select("item_id", "doc_id").distinct()
    met = pairs.join(q, "item_id").join(d, "doc_id").withColumn("k", F.size(F.array_intersect("terms", "have"))).withColumn("n", F.size("have")).withColumn("m", F.size("terms")).where(F.col("k") >= 0.9 * F.col("m"))
    c, j = F.col("k") / F.least("n", "m"), F.col("k") / (F.col("n") + F.col("m") - F.col("k"))
    return met.select("item_id", "doc_id", F.round(c, 6).alias("containment"), F.round(0.55 * j + 0.45 * c, 6).alias("identity"))


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name || '  \"' || p_type || '\"', '[\"''`]+', '', 'g'))) AS q0, regexp_replace(lower(trim(regexp_replace(p_name || '  \"' || p_type || '\"', '[\"''`]+', '', 'g'))), '\\s+', ' ', 'g') AS query, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, upper(regexp_replace(p_brand || '-' || p_partkey, '[\\s\\-._/]+', '', 'g')) AS code FROM part")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C24, C25, C26."""
    p = table(spark, sf_dir, "part")
    quoted = F.concat(F.col("p_name"), F.lit('  "'), F.col("p_type"), F.lit('"'))
    return p.select("p_partkey", F.lower(F.trim(F.regexp_replace(quoted, "[\"'`]+", ""))).alias("q0"), T.normal_query(quoted).alias("query"), T.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"), T.normal_code(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))).alias("code"))


@query("""WITH w AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS h FROM part),
  s AS (SELECT p_partkey, list_distinct(regexp_extract_all(h, '[a-z0-9]+')) AS t FROM w)
  SELECT p_partkey, greatest(list_contains(t, 'red')::INTEGER + list_contains(t, 'ring')::INTEGER, list_contains(t, 'small')::INTEGER + list_contains(t, 'economy')::INTEGER) AS score FROM s""")
def catalogue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10, C32."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.match_score([["red", "ring"], ["small", "economy"]], F.concat_ws(" ", "p_name", "p_type")).alias("score"))


@query("""WITH c AS (SELECT p_partkey, p_name, p_size % 7 AS k, p_retailprice FROM part),
  t AS (SELECT p_partkey, CASE k WHEN 0 THEN '@shop_' || p_partkey WHEN 1 THEN '$' || p_partkey WHEN 2 THEN 'Made in Italy' WHEN 3 THEN 'AW' || lpad((p_partkey % 100)::VARCHAR, 2, '0') WHEN 4 THEN 'AB-' || (1000 + p_partkey) WHEN 5 THEN 'EU42' ELSE upper(split_part(p_name, ' ', 2)) END AS token FROM c)
  SELECT p_partkey, token, CASE WHEN token LIKE '@%' THEN 'handle' WHEN token LIKE '$%' THEN 'overlay' WHEN token LIKE 'Made%' THEN 'country' WHEN regexp_full_match(token, 'AW[0-9][0-9]') THEN 'season' WHEN token LIKE 'AB-%' THEN 'product_code' WHEN token = 'EU42' THEN 'size' WHEN regexp_full_match(token, '[A-Z]{4,16}') AND lower(token) NOT IN ('size', 'sold', 'from', 'with', 'this', 'that', 'italy', 'france', 'spain', 'china') THEN 'brand' ELSE 'unknown' END AS class FROM t""")
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first class that fits."""
    p = table(spark, sf_dir, "part")
    k, key = F.col("p_size") % 7, F.col("p_partkey").cast("string")
    token = (
        F.when(k == 0, F.concat(F.lit("@shop_"), key)).when(k == 1, F.concat(F.lit("$"), key)).when(k == 2, "Made in Italy")
        .when(k == 3, F.concat(F.lit("AW"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))).when(k == 4, F.concat(F.lit("AB-"), (1000 + F.col("p_partkey")).cast("string")))
        .when(k == 5, "EU42").otherwise(F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))))
    )
    return p.select("p_partkey", token.alias("token")).select("p_partkey", "token", T.token_class(F.col("token"), ["leather", "suede"], ["red", "blue"], ["small"]).alias("class"))
