"""The warm index as stored tables, and what reads feeds, catalogues, lists and caches into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import text as T
from quarry.functions import url as U
from quarry.operators import index, planning
from quarry.operators.warm import WarmIndex, descriptor_of, prepared
from quarry.plans.registry import query, spread, table
from quarry.plans.searching import ASKED_SQL, TOKENS_SQL, VECTOR_SQL
from quarry.sources import feeds, sinks

VERSIONS = {"adapter_version": "a1", "model_version": "m1", "parameters": "p", "schema_version": "3", "policy_version": "matching-1"}
TERMS = ["hand", "ering", "anion", "2024"]


def _one_of(k: Column, *values: object) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


def _listings(spark: SparkSession, sf_dir: str, which: Column | None = None) -> DataFrame:
    """Documents, those of `which` or all, as listings; every tenth was read under an older policy."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    d = d if which is None else d.where(which)
    at = F.timestamp_seconds(1_700_000_000 + k % 1000)
    versions = [F.lit(v).alias(c) for c, v in VERSIONS.items() if c != "policy_version"] + [F.when(k % 10 == 0, "matching-0").otherwise("matching-1").alias("policy_version")]
    return d.select(k.alias("listing_key"), F.concat(F.lit("https://x.example/"), k.cast("string")).alias("canonical_url"), F.sha2("text", 256).alias("content_digest"), F.lit("LIVE").alias("availability"), at.alias("first_seen_at"), at.alias("updated_at"), "text", *versions)


def _built(spark: SparkSession, sf_dir: str) -> WarmIndex:
    """All listings in batch 1; those of src1 again in batch 2, a day later. Built once a session and input."""
    warm, rows = prepared(spark, sf_dir, "twice"), _listings(spark, sf_dir)
    warm.put(rows, {"text": "text"}, 1)
    again = _listings(spark, sf_dir, F.col("source") == "src1")
    later = again.withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 1 DAY")).withColumn("first_seen_at", F.col("updated_at")).withColumn("availability", F.lit("SOLD"))
    warm.put(later, {"text": "text"}, 2)
    return warm


def _catalogue(spark: SparkSession, sf_dir: str) -> WarmIndex:
    """Documents as listings, with vectors as descriptors of the photographs of the listings of their ids. Built once a session and input."""
    docs, vectors = _listings(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("listing_key"), F.col("embedding").alias("descriptor"))
    bare = vectors.select("listing_key").join(docs.select("listing_key"), "listing_key", "left_anti")
    warm = prepared(spark, sf_dir, "catalogue")
    warm.put(docs.unionByName(bare, allowMissingColumns=True), {"text": "text"}, 1, vectors)
    return warm


@query(f"WITH {TOKENS_SQL} SELECT count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS listings, count(*) AS tokens, (SELECT count(*) FROM embeddings) AS images FROM tok")
def warm_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index holds; builds it if this session has not."""
    warm = _catalogue(spark, sf_dir)
    held = warm.postings()
    terms = held.groupBy("term").agg(F.sum("tf").alias("tf")).agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("tokens"))
    listings = held.select("listing_key").distinct().agg(F.count(F.lit(1)).alias("listings"))
    return terms.join(F.broadcast(listings)).select("terms", "listings", "tokens").join(F.broadcast(warm.descriptors(kind="image").agg(F.count(F.lit(1)).alias("images"))))  # one row


@query(f"""WITH {TOKENS_SQL}, {ASKED_SQL}, {VECTOR_SQL}
  SELECT coalesce(t.query_id, h.query_id) AS query_id, coalesce(t.listing_key, h.listing_key) AS listing_key, coalesce(t.term_score, 0) AS term_score, coalesce(h.descriptor_score, 0) AS descriptor_score
  FROM txt t FULL JOIN hits h ON t.query_id = h.query_id AND t.listing_key = h.listing_key""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes of every query that asks, from the stored postings and descriptors, met by listing."""
    asked = T.token_rows(table(spark, sf_dir, "benchmark").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "text"), ["query_id"], "text")
    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("listing_key"), F.col("embedding").alias("descriptor"))
    return _catalogue(spark, sf_dir).hybrid_many(asked, vectors)


@query(f"""WITH {TOKENS_SQL}, s AS (SELECT doc_id AS listing_key, count(*) AS term_score FROM tok WHERE term IN ({', '.join(repr(t) for t in TERMS)}) GROUP BY 1)
  SELECT * FROM s ORDER BY term_score DESC, listing_key LIMIT 50""")
def warm_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts that run twice, then all as one batch without what was replaced: the scores of a search stay."""
    warm, rows = prepared(spark, sf_dir, "compacted"), _listings(spark, sf_dir)
    for batch in (1, 2, 2, 1):
        warm.put(rows.where(F.col("listing_key") % batch == 0), {"text": "text"}, batch)
    warm.compact()
    return warm.search(TERMS)


@query(f"WITH {TOKENS_SQL} SELECT doc_id AS listing_key, count(*) AS term_score FROM tok WHERE term IN ({', '.join(repr(t) for t in TERMS)}) AND doc_id % 10 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def warm_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put twice, then one query's terms under one version; only their buckets are read, nothing counts twice."""
    return _built(spark, sf_dir).search(TERMS, versions=VERSIONS)


@query(f"WITH {TOKENS_SQL}, {ASKED_SQL} SELECT * FROM txt")
def warm_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4: every benchmark item that asks, against the stored postings."""
    asked = T.token_rows(table(spark, sf_dir, "benchmark").where(F.col("item_id") % 20 == 0).select(F.col("item_id").alias("query_id"), "text"), ["query_id"], "text")
    return _built(spark, sf_dir).search_many(asked)


@query("""SELECT doc_id AS listing_key, CASE WHEN source = 'src1' THEN 'SOLD' ELSE 'LIVE' END AS availability, epoch(first_seen_at)::BIGINT AS first_seen, epoch(first_seen_at)::BIGINT + CASE WHEN source = 'src1' THEN 86400 ELSE 0 END AS updated, (SELECT count(*) FROM documents) AS n
  FROM (SELECT *, to_timestamp(1700000000 + doc_id % 1000) AS first_seen_at FROM documents) WHERE doc_id % 3 = 0 AND doc_id % 10 <> 0""")
def warm_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, B1, F2, K9: by URL under exact versions the newest row, the first sight kept; the index counts each listing once."""
    warm = _built(spark, sf_dir)
    urls = _listings(spark, sf_dir).where(F.col("listing_key") % 3 == 0).select("canonical_url")
    found = warm.by_url(urls, VERSIONS).select("listing_key", "availability", F.unix_timestamp("updated_at").alias("updated"))
    first = warm.listings().select("listing_key", F.unix_timestamp("first_seen_at").alias("first_seen"))
    return found.join(first, "listing_key").join(F.broadcast(warm.count()))  # one row


@query("SELECT doc_id AS listing_key, CASE WHEN source = 'src1' THEN 'SOLD' ELSE 'LIVE' END AS availability, 1::BIGINT AS n FROM documents WHERE doc_id = 20")
def warm_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: one listing by its key."""
    return _built(spark, sf_dir).point(20).groupBy("listing_key", "availability").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TOKENS_SQL}, b AS (SELECT doc_id, ('0x' || substr(sha256(term), 1, 8))::BIGINT % 64 AS bucket FROM tok WHERE doc_id % 7 = 0), c AS (SELECT doc_id, bucket, count(*) AS n FROM b GROUP BY ALL), z AS (SELECT doc_id, sqrt(sum(n * n)) AS z FROM c GROUP BY 1)
  SELECT c.doc_id AS listing_key, bucket::INTEGER AS at, round(n / z, 6) AS weight FROM c JOIN z USING (doc_id)""")
def warm_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of a list of keys, of the newest put only; zeros left out."""
    keys = table(spark, sf_dir, "documents").where(F.col("doc_id") % 7 == 0).select(F.col("doc_id").alias("listing_key"))
    rows = _built(spark, sf_dir).descriptors(keys).where(F.col("kind") == "hashed_text").select("listing_key", F.posexplode("descriptor").alias("at", "w"))
    return rows.where(F.col("w") > 0).select("listing_key", "at", F.round("w", 6).alias("weight"))


@query("""SELECT p_partkey AS listing_key, p_size::DOUBLE / 50 + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS item_match, (SELECT count(DISTINCT p_brand) FROM part) AS queries FROM part""")
def warm_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and queries of two campaigns, the later one's kept."""
    warm, p = WarmIndex(spark), table(spark, sf_dir, "part")
    evidence = p.select(F.col("p_partkey").alias("listing_key"), F.lit("h").alias("hypothesis_digest"), (F.col("p_size") / 50.0).alias("item_match"), F.lit(0.5).alias("authenticity"), F.lit(1.0).alias("completeness"))
    queries = p.select(F.sha2("p_brand", 256).alias("ior_key"), F.lit("feed").alias("source_id"), F.lower("p_brand").alias("query_norm"), F.lit(1).cast("long").alias("pages")).distinct()
    warm.remember(evidence, queries, 1)
    warm.remember(evidence.where(F.col("listing_key") % 2 == 0).withColumn("item_match", F.col("item_match") + 1), queries, 2)
    return warm.evidence().select("listing_key", "item_match").join(F.broadcast(warm.queries_run().agg(F.count(F.lit(1)).alias("queries"))))  # one row


@query("""SELECT vec_id AS k, CASE WHEN vec_id % 3 = 0 THEN 64 WHEN vec_id % 3 = 1 THEN 24 ELSE 64 END AS dim, CASE WHEN vec_id % 3 = 0 THEN round(embedding[1]::DOUBLE, 6) WHEN vec_id % 3 = 1 THEN 0.5 ELSE 0 END::DOUBLE AS first FROM embeddings""")
def fallback_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: an embedding, else a histogram, else the fingerprint hashed."""
    k = F.col("vec_id")
    d = descriptor_of(F.when(k % 3 == 0, F.col("embedding").cast("array<double>")), F.when(k % 3 == 1, F.array_repeat(F.lit(0.5), 24)), F.lit("00ff00ff00ff00ff"))
    rows = table(spark, sf_dir, "embeddings").select(k.alias("k"), d.alias("d"))
    return rows.select("k", F.size("d").alias("dim"), F.round(F.get("d", 0), 6).alias("first"))


@query("""SELECT p_partkey AS k, 'https://x.example/products/h' || p_partkey AS url, p_name AS title, p_brand AS vendor, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice::DECIMAL(18,2)::VARCHAR END AS price, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS images, p_partkey % 4 > 0 AND p_partkey % 2 = 0 AS available FROM part WHERE p_partkey % 9 > 0""")
def feed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of JSON feeds; a body that is no feed gives nothing."""
    k = F.col("p_partkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    variants = F.when(k % 4 > 0, F.concat(F.lit('{"price":'), quoted(F.col("p_retailprice").cast("decimal(18,2)").cast("string")), F.lit(',"available":'), (k % 2 == 0).cast("string"), F.lit("}"))).otherwise("")
    images = F.when(k % 3 > 0, '{"src":"https://x.example/1.jpg"},{"src":"https://x.example/2.jpg"}').otherwise("")
    body = F.concat(F.lit('{"products":[{"id":'), k.cast("string"), F.lit(',"title":'), quoted(F.col("p_name")), F.lit(',"handle":"h'), k.cast("string"), F.lit('","vendor":'), quoted(F.col("p_brand")), F.lit(',"images":['), images, F.lit('],"variants":['), variants, F.lit("]}]}"))
    pages = table(spark, sf_dir, "part").select(F.when(k % 9 > 0, body).otherwise("<html>no feed</html>").alias("body"), F.lit("https://x.example").alias("origin"))
    m = feeds.feed_members(pages, "body", "origin")
    return m.select(F.regexp_extract("url", "h([0-9]+)$", 1).cast("long").alias("k"), "url", "title", "vendor", "price", F.size("images").alias("images"), "available")


@query("""WITH k AS (SELECT p_partkey AS k, p_partkey % 4 AS s FROM part), m AS (SELECT k, s, unnest(['a', 'b']) AS x FROM k)
  SELECT k, 'https://x.example/items/' || x || k AS member FROM m WHERE NOT (s = 3 AND x = 'b')""")
def listed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members from JSON-LD lists, else sitemaps, else links; other hosts and paths fall out."""
    k = F.col("p_partkey").cast("string")
    a, b = (F.concat(F.lit(f"https://x.example/items/{x}"), k) for x in "ab")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"url":"'), a, F.lit('"},{"item":{"url":"'), b, F.lit('/"}}]}</script><a href="/items/no">'))
    site = F.concat(F.lit("<urlset><url><loc> "), a, F.lit(" </loc></url><url><loc>"), b, F.lit("</loc></url><url><loc>https://other.example/items/z</loc></url></urlset>"))
    links = F.concat(F.lit('<a href="/items/a'), k, F.lit('"></a><a href="/items/b'), k, F.lit('?utm_source=x"></a><a href="/about">'))
    far = F.concat(F.lit('<a href="/items/a'), k, F.lit('"></a><a href="https://far.example/items/b'), k, F.lit('"></a>'))
    body = F.element_at(F.array(ld, site, links, far), (F.col("p_partkey") % 4 + 1).cast("int"))
    pages = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(body.alias("body"), F.concat(F.lit("https://x.example/list/"), k).alias("url"))
    m = feeds.members(pages, "body", "url", ["/items/"], ["x.example"])
    return m.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("k"), "member")


WALK_SQL = """
  m AS (SELECT p_brand AS source_id, p_partkey // 50 AS page, 'https://x.example/items/' || p_partkey AS url, (p_name LIKE 'red%')::INTEGER + (p_name LIKE '%ring')::INTEGER AS score, p_partkey AS k FROM part),
  g AS (SELECT source_id, page, CASE WHEN source_id = 'Brand#3' AND page = 2 THEN 0 ELSE 5 END AS n FROM (SELECT DISTINCT source_id, page FROM m)),
  o AS (SELECT *, max((n = 0)::INTEGER) OVER (PARTITION BY source_id ORDER BY page) AS ended, row_number() OVER (PARTITION BY source_id ORDER BY page) AS i FROM g),
  w AS (SELECT source_id, page FROM o WHERE ended = 0 AND i <= 6 ORDER BY source_id, page LIMIT 100),
  r AS (SELECT m.*, CASE WHEN w.page IS NULL THEN 'page_cap' WHEN k % 17 = 0 THEN 'off_host' WHEN k % 13 = 0 THEN 'disallowed' WHEN k % 11 = 0 THEN 'already_seen' WHEN score = 0 THEN 'no_query_hit' END AS r FROM m LEFT JOIN w USING (source_id, page)),
  u AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'https://far.example/items/' || k WHEN k % 13 = 0 THEN 'https://x.example/search/' || k ELSE url END AS u FROM r),
  p AS (SELECT *, row_number() OVER (PARTITION BY source_id, r IS NULL ORDER BY score DESC, u) AS k1 FROM u),
  f AS (SELECT source_id, u FROM p WHERE r IS NULL AND k1 <= 4 ORDER BY score DESC, u LIMIT 60),
  d AS (SELECT p.source_id, p.u AS url, score, coalesce(r, CASE WHEN k1 > 4 THEN 'source_cap' WHEN f.u IS NULL THEN 'campaign_cap' END) AS drop_reason FROM p LEFT JOIN f ON f.source_id = p.source_id AND f.u = p.u)
"""


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    url = F.when(k % 17 == 0, F.concat(F.lit("https://far.example/items/"), k.cast("string"))).when(k % 13 == 0, F.concat(F.lit("https://x.example/search/"), k.cast("string"))).otherwise(F.concat(F.lit("https://x.example/items/"), k.cast("string")))
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_id"), F.floor(k / 50).alias("page"), url.alias("url"), F.col("p_name").alias("haystack"), k.alias("k"))
    pages = members.select("source_id", "page").distinct().withColumn("n_members", F.when((F.col("source_id") == "Brand#3") & (F.col("page") == 2), 0).otherwise(5))
    seen = members.where(F.col("k") % 11 == 0).select("url")
    return feeds.walk(pages, members.drop("k"), [["red", "ring"]], seen, ["/private"], ["x.example"], {"pages_per_source": 6, "pages_per_campaign": 100, "promote_per_source": 4, "promote_per_campaign": 60})


@query(f"WITH {WALK_SQL} SELECT url, score, drop_reason FROM d")
def catalogue_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages up to the caps, members with the first reason that drops them, promotion by score within two caps."""
    return _walked(spark, sf_dir).select("url", "score", "drop_reason")


@query(f"WITH {WALK_SQL} SELECT coalesce(drop_reason, 'promoted') AS reason, count(*) AS n FROM d GROUP BY 1")
def walk_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of all members."""
    return feeds.ledger(_walked(spark, sf_dir)).select(F.coalesce("drop_reason", F.lit("promoted")).alias("reason"), "n")


@query("""WITH m AS (SELECT p_brand AS url, 'https://x.example/' || p_name || '/' || p_partkey AS member, (p_name LIKE 'red%')::INTEGER + (p_name LIKE '%ring')::INTEGER AS score, p_partkey % 4 AS depth, p_partkey AS k FROM part),
  r AS (SELECT *, CASE WHEN depth > 2 THEN 'max_depth' WHEN k % 11 = 0 THEN 'already_seen' WHEN score = 0 THEN 'no_query_hit' END AS r FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY url, r IS NULL ORDER BY score DESC, member) AS n FROM r)
  SELECT member, score, coalesce(r, CASE WHEN n > 3 THEN 'index_cap' END) AS drop_reason FROM p""")
def index_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of lists by hits, with the first reason that drops them."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("url"), F.concat(F.lit("https://x.example/"), "p_name", F.lit("/"), k.cast("string")).alias("member"), (k % 4).alias("depth"), k.alias("k"))
    out = feeds.expand(rows, [["red", "ring"]], rows.where(F.col("k") % 11 == 0).select("member"), 3, F.col("depth"), 2)
    return out.select("member", "score", "drop_reason")


@query("""SELECT 'no_image' AS state, count(*) FILTER (p_partkey % 5 = 0) AS n FROM part UNION ALL SELECT 'no_descriptor', count(*) FILTER (p_partkey % 5 > 0 AND p_partkey % 3 = 0) FROM part UNION ALL SELECT 'put', count(*) FILTER (p_partkey % 5 > 0 AND p_partkey % 3 > 0) FROM part
  UNION ALL SELECT 'descriptors', sum(least(3, p_partkey % 5)) FILTER (p_partkey % 5 > 0 AND p_partkey % 3 > 0)::BIGINT FROM part""")
def catalogue_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three photographs of each product; those without, or without a descriptor, are counted."""
    k = F.col("p_partkey")
    names = F.transform(F.sequence(F.lit(1), F.greatest(k % 5, F.lit(1)).cast("int")), lambda i: F.concat_ws("-", k.cast("string"), i.cast("string")))
    products = table(spark, sf_dir, "part").select(k.cast("string").alias("url"), F.col("p_name").alias("title"), F.when(k % 5 > 0, names).otherwise(F.slice(names, 1, 0)).alias("images"))
    described = products.select(F.explode("images").alias("image"), "url").where(F.col("url").cast("long") % 3 > 0).select("image", F.array(F.lit(1.0)).alias("descriptor"))
    listings, counts = feeds.ingest(products, described)
    return counts.unionByName(listings.agg(F.sum(F.size("descriptors")).alias("n")).select(F.lit("descriptors").alias("state"), "n"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'cache' WHEN page_id % 3 = 0 THEN 'none' ELSE 'page' END AS origin, CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN 'kept ' || page_id WHEN page_id % 3 > 0 THEN html END AS body FROM pages")
def response_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unchanged pages come from the cache, by canonical URL."""
    k = F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://x.example/p/"), k, F.lit("/?utm_source=a")).alias("url"), F.when(F.col("page_id") % 3 > 0, F.col("html")).alias("body"), F.when(F.col("page_id") % 3 == 0, 304).otherwise(200).alias("status"))
    cache = p.where(F.col("page_id") % 2 == 0).select(F.concat(F.lit("https://x.example/p/"), k).alias("canonical_url"), F.lit("e").alias("etag"), F.concat(F.lit("kept "), k).alias("cached_body"))
    return feeds.cached(p.select("url", "body", "status"), cache).select(F.regexp_extract("canonical_url", "([0-9]+)$", 1).cast("long").alias("page_id"), "origin", "body")


@query("SELECT p_partkey AS k, p_name AS text, least(100, p_size * 3) / 100e0 AS confidence FROM part WHERE p_size % 4 > 0")
def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with confidence; layout rows and blanks fall out."""
    s = F.col("p_size")
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(s % 8 == 4, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("text"), F.when(s % 8 == 0, -1.0).otherwise(s * 3.0).alias("conf"))
    return feeds.ocr_rows(raw).select("k", "text", "confidence")


@query("""SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'other' WHEN 1 THEN 'index' WHEN 2 THEN 'product' WHEN 3 THEN 'product' WHEN 4 THEN 'index' WHEN 5 THEN 'index' WHEN 6 THEN 'product' WHEN 7 THEN 'index' ELSE 'other' END AS class FROM part""")
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error pages, URLs that speak, bodies that contradict them, JSON-LD graphs, paths."""
    cases = [("https://x.example/products/a", "<title>404 Not Found</title>"), ("https://x.example/collections/bags", "text"), ("https://x.example/collections/bags/products/a", "text"), ("https://x.example/search?q=a", '{"product":{"id":1}}'), ("https://x.example/products/a", ' {"products":[]}'),
             ("https://x.example/x", "<urlset></urlset>"), ("https://x.example/x", '<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["Product"]}]}</script>'), ("https://x.example/x", '<script type="application/ld+json">[{"@type":"Product"},{"@type":"ItemList"}]</script>'), ("https://x.example/about", "<p>hello</p>")]
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), H.document_class(_one_of(k, *(u for u, _ in cases)), _one_of(k, *(b for _, b in cases)), ["/shop/"]).alias("class"))


@query("""SELECT p_partkey AS k, 'Item ' || p_name AS title, 'https://x.example/' || p_partkey || '.jpg' AS image, CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 60 END::DOUBLE AS wait FROM part""")
def page_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page without data of its own, read from its elements; how long a server asks to wait."""
    k = F.col("p_partkey")
    body = F.concat(F.lit("<html><title>no</title><h1> Item <i>"), "p_name", F.lit('</i></h1><img class=a src="https://x.example/'), k.cast("string"), F.lit('.jpg"></html>'))
    wait = H.retry_after(F.when(k % 2 == 0, "30").otherwise("Fri, 01 Mar 2024 00:10:00 GMT"), F.to_timestamp(F.lit("2024-03-01 00:00:00")))
    return table(spark, sf_dir, "part").select(k.alias("k"), H.extract_listing(body).alias("x"), wait.alias("wait")).select("k", "x.title", "x.image", "wait")


@query("""SELECT count(*) AS objects, sum(length(p_name))::BIGINT AS bytes, true AS refused, (SELECT count(*) FROM events) AS appended FROM (SELECT DISTINCT p_name FROM part)""")
def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents kept once over two puts, an update against another version refused, events appended."""
    from quarry.operators.cluster import checkpoint_dir
    import uuid

    base = f"{checkpoint_dir(spark)}/objects-{uuid.uuid4().hex}"
    files = table(spark, sf_dir, "part").select(F.col("p_name").cast("binary").alias("content"))
    sinks.put_objects(files, base)
    sinks.put_objects(files, base)
    try:
        sinks.checked_version(1, 2)
        refused = False
    except ValueError:
        refused = True
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    for half in (0, 1):
        sinks.append(e.where(F.col("event_id") % 2 == half), f"{base}-log")
    kept = spark.read.parquet(base).agg(F.count(F.lit(1)).alias("objects"), F.sum(F.length("content")).alias("bytes"))
    return kept.withColumn("refused", F.lit(refused)).join(F.broadcast(spark.read.parquet(f"{base}-log").agg(F.count(F.lit(1)).alias("appended"))))  # one row


@query("SELECT o_orderpriority AS search_id, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1")
def purged_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One campaign's rows purged, the others' left."""
    from quarry.operators.cluster import checkpoint_dir
    import uuid

    path = f"{checkpoint_dir(spark)}/campaigns-{uuid.uuid4().hex}"
    sinks.append(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("search_id")), path, "search_id")
    sinks.purge(spark, path, "search_id", "1-URGENT")
    return spark.read.schema("o_orderkey long, search_id string").parquet(path).groupBy("search_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'old' ELSE 'new' END AS wrote FROM events WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND event_id % 2 = 0)""")
def inserted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose key is there already do not come in again."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    old, k = e.where(F.col("event_id") % 3 == 0).withColumn("wrote", F.lit("old")), F.col("event_id")
    new = e.where((k % 3 == 0) | ((k % 3 == 1) & (k % 2 == 0))).withColumn("wrote", F.lit("new"))
    return index.insert_once(old, new.unionByName(new), ["event_id", "user_id"])


@query("""SELECT p_partkey AS k, p_partkey % 4 IN (1, 2) AS refused, p_partkey % 3 = 0 AS has_old, CASE WHEN p_partkey % 2 = 0 THEN 'new' WHEN p_partkey % 3 = 0 THEN 'old' END AS state FROM part""")
def refused_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with private paths or markup stay out of the index; runtime maps are merged, the new value wins."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), F.concat("p_name", _one_of(k, "", " file:///Users/a", " <SCRIPT src=x>", " it's / fine")).alias("title"))
    good, bad = index.refused(rows, ["k", "title"])
    marked = good.select("k", F.lit(False).alias("refused")).unionByName(bad.select("k", F.lit(True).alias("refused")))
    old, new = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("state"), F.lit("old"), F.lit("kept"), F.lit("y"))), F.when(F.col("k") % 2 == 0, F.create_map(F.lit("state"), F.lit("new")))
    merged = marked.withColumn("a", old).withColumn("b", new).withColumn("m", sinks.merged_maps("a", "b"))
    return merged.select("k", "refused", F.coalesce(F.map_contains_key("m", "kept"), F.lit(False)).alias("has_old"), F.try_element_at("m", F.lit("state")).alias("state"))


@query("""WITH q AS (SELECT p_brand AS search_id, p_partkey AS k, p_name AS text, ['en', 'ja', 'fr'][p_partkey % 3 + 1] AS language, p_size / 50e0 AS gain FROM part), a(source_id, language) AS (VALUES ('kind', 'ja'), ('komehyo', 'ja'), ('ebay', 'en')),
  r AS (SELECT *, row_number() OVER (PARTITION BY search_id, source_id ORDER BY gain DESC, text, k) AS n FROM q JOIN a USING (language) WHERE text NOT LIKE 'red%' OR search_id > 'Brand#2')
  SELECT search_id, source_id, count(*) AS n, round(sum(gain), 6) AS gain FROM r WHERE n <= 4 GROUP BY ALL""")
def routed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without demoted terms, four for each source that takes their language."""
    k = F.col("p_partkey")
    q = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search_id"), F.col("p_name").alias("text"), _one_of(k, "en", "ja", "fr").alias("language"), (F.col("p_size") / 50.0).alias("gain"))
    demoted = q.where(F.col("search_id") <= "Brand#2").select("search_id").distinct().withColumn("term", F.lit("RED"))
    admitted = spark.createDataFrame([("kind", "ja"), ("komehyo", "ja"), ("ebay", "en")], "source_id string, language string")
    out = planning.source_queries(planning.drop_demoted(q, demoted), admitted)
    return out.groupBy("search_id", "source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("gain"), 6).alias("gain"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'searxng=' || p_name || ' boots used|wikipedia=' || p_name || '|marginalia=' || p_name || ' boots used|internet_archive=' || p_name || ' boots used' WHEN 1 THEN 'komehyo=' || p_name || ' 中古|kind=' || p_name || ' 中古|wikipedia_ja=' || p_name WHEN 2 THEN 'wikipedia_fr=' || p_name WHEN 3 THEN '' ELSE '' END AS forms,
  CASE p_partkey % 10 WHEN 0 THEN 'UNMEASURABLE' WHEN 1 THEN 'NOT_ATTEMPTED' WHEN 2 THEN 'BLOCKED_BY_POLICY' WHEN 3 THEN 'AUTH_REQUIRED' WHEN 4 THEN 'BLOCKED_BY_POLICY' WHEN 5 THEN 'NOT_ATTEMPTED' WHEN 6 THEN 'RATE_LIMITED' WHEN 7 THEN 'SOURCE_UNAVAILABLE' WHEN 8 THEN 'UNMEASURABLE' END AS outcome FROM part""")
def source_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a query is put to the sources of its language, and why a source is not asked."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    forms = planning.source_forms(_one_of(k, "en", "ja", "fr", "xx", "en"), F.when(k % 5 == 4, "").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))), F.when(k % 5 < 4, F.split_part("p_name", F.lit(" "), F.lit(2))), _one_of(k, "used", "中古", "occasion", "used", "used"), F.when(k % 5 == 0, "boots"))
    text, n = lambda *x: F.array(*(F.lit(v) for v in x)), k % 10
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"), F.array_join(F.transform(forms, lambda f: F.concat(f["source"], F.lit("="), f["text"])), "|").alias("forms"), (n != 0).alias("known"), (n != 1).alias("selected"), (n != 2).alias("enabled"), F.lit(False).alias("include_disabled"), (n == 3).alias("needs_credential"), F.when(n == 4, "BLOCKED").otherwise("ADMITTED").alias("admission"),
        F.when(n == 5, text("ja")).otherwise(text("en", "fr")).alias("languages"), text("fr", "de").alias("asked"), F.lit(False).alias("general"), F.when(n == 6, "RATE_LIMITED").alias("health"), F.when(n == 7, "SOURCE_UNAVAILABLE").otherwise(none).alias("unavailable"), (n != 8).alias("budget_left"),
    )
    return planning.coverage_reason(rows).select("k", "forms", "outcome")


@query("""WITH q AS (SELECT p_brand AS search_id, p_name AS text, min(p_partkey) AS k FROM part GROUP BY ALL), s(source_id) AS (VALUES ('a'), ('b'))
  SELECT search_id, text, source_id FROM q, s WHERE NOT (source_id = 'a' AND text LIKE 'red%')""")
def not_run_yet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries and sources that have not met under these versions."""
    q = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search_id"), F.col("p_name").alias("text")).distinct()
    sources = spark.createDataFrame([("a", "v1"), ("b", "v1")], "source_id string, versions string")
    ran = q.where(F.col("text").startswith("red")).select(F.sha2(F.concat_ws("|", F.lit("a"), T.normal_query(F.upper("text")), F.lit("v1")), 256).alias("key")).distinct()
    return planning.already_run(q, sources, ran).select("search_id", "text", "source_id")


@query("""WITH b AS (SELECT user_id AS key, min(event_id) AS k FROM events GROUP BY 1), n AS (SELECT user_id AS key, max(value / 100) AS c, arg_max(event_type, (value / 100, event_type)) AS v FROM events GROUP BY 1)
  SELECT b.key, CASE WHEN n.c > 0.5 THEN n.v ELSE 'first' END AS value, round(CASE WHEN n.c > 0.5 THEN n.c ELSE 0.5 END, 6) AS confidence, coalesce(n.c > 0.5, false)::INTEGER AS history FROM b LEFT JOIN n USING (key)""")
def updated_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest news of each belief; what was believed before goes to its history."""
    e = table(spark, sf_dir, "events")
    beliefs = e.select(F.col("user_id").alias("key")).distinct().select("key", F.lit("first").alias("value"), F.lit(0.5).alias("confidence"), F.array().cast("array<struct<value:string,confidence:double>>").alias("history"))
    news = e.select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), (F.col("value") / 100).alias("confidence"))
    return planning.update_belief(beliefs, news).select("key", "value", F.round("confidence", 6).alias("confidence"), F.size("history").alias("history"))


@query("SELECT c.url, c.page_id AS first, n FROM (SELECT url, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1) c")
def first_seen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each once, the first sight kept."""
    w = Window.partitionBy("url").orderBy("page_id")
    p = table(spark, sf_dir, "pages").select("url", "page_id", F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("url")).alias("all"))
    return p.where(F.col("n") == 1).select("url", F.col("page_id").alias("first"), F.col("all").alias("n"))


@query("SELECT page_id, page_id % 5 > 0 AS refused FROM pages")
def guarded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes, names, users and addresses that are refused, of the URL and of what it resolves to (a column)."""
    made = _one_of(F.col("page_id"), "https://x.example/a", "ftp://x.example/", "https://u:p@x.example/", "https://192.168.1.4/a", "https://intranet.internal/")
    return _pages_guarded(table(spark, sf_dir, "pages").select("page_id", made.alias("url"), F.array(F.lit("93.184.216.34")).alias("resolved")))


def _pages_guarded(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", U.is_refused(F.col("url"), F.col("resolved")).alias("refused"))
