"""Signals of retrieval, vectors and hashes, request reading, drafts, repairs, image kernels, answers to readers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import authenticity as A
from quarry.functions import images as I
from quarry.functions import records as R
from quarry.functions import scores as S
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import campaign, cluster, keypoints, matching, metrics, planning, ranking
from quarry.plans.campaigns import JUDGED_SQL, judged
from quarry.plans.registry import query, table


def _one_of(k: Column, *values: object) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


@query("""WITH x AS (SELECT vec_id AS k, embedding::DOUBLE[] AS e, list_reverse(embedding)::DOUBLE[] AS r FROM embeddings)
  SELECT k, round(list_dot_product(e, r), 6) AS dot, round(greatest(0, 1 - 5e-1 * list_sum(list_transform(list_zip(e, r), lambda p: abs(p[1] - p[2]))) / 64), 6) AS histogram, 2 * (k % 3) + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS hex, round(1 - (2 * (k % 3) + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END) / 64, 6) AS similarity,
    CASE k % 4 WHEN 0 THEN 'f' || k WHEN 1 THEN 'd' WHEN 2 THEN 'phash:ff' ELSE sha256('u' || k) END AS family, round(sqrt(k % 7 * (k % 7) * 3) / 441.67e0, 6) AS colour, bit_count(xor(k, 12345)::BIGINT)::INTEGER AS bits FROM x""")
def vector_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot products, histograms, hex distances, image families, colours, bit distances."""
    k, e = F.col("vec_id"), F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select(k.alias("k"), e.alias("e"), F.reverse(e).alias("r"))
    k, part = F.col("k"), lambda a: F.transform(a, lambda x: x / 64)
    other = F.concat(F.element_at(F.array(F.lit("0000"), F.lit("0f0f"), F.lit("ffff")), (k % 3 + 1).cast("int")), F.when(k % 2 == 0, "00").otherwise(""))
    grey = F.array(*(F.lit(50.0) + k % 7 for _ in range(3)))
    return rows.select(
        "k", F.round(V.dot(F.col("e"), F.col("r")), 6).alias("dot"), F.round(V.histogram_similarity(part(F.col("e")), part(F.col("r"))), 6).alias("histogram"), V.hex_distance(F.lit("0000"), other).cast("long").alias("hex"), F.round(V.hash_similarity(F.lit("0000"), other), 6).alias("similarity"),
        V.image_family(F.when(k % 4 == 0, F.concat(F.lit("f"), k.cast("string"))), F.when(k % 4 == 1, "d").otherwise(""), F.when(k % 4 == 2, "ff"), F.concat(F.lit("u"), k.cast("string"))).alias("family"), F.round(S.colour_distance(F.array(*(F.lit(50.0) for _ in range(3))), grey), 6).alias("colour"), F.bit_count(k.bitwiseXOR(F.lit(12345))).alias("bits"),
    )


@query("""WITH x AS (SELECT vec_id AS k, list_transform(embedding, lambda v: (v::DOUBLE >= list_sum(embedding::DOUBLE[]) / 64)::INTEGER) AS b FROM embeddings)
  SELECT k, array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', (8 * b[i * 4 + 1] + 4 * b[i * 4 + 2] + 2 * b[i * 4 + 3] + b[i * 4 + 4] + 1)::BIGINT, 1)), '') AS fingerprint FROM x""")
def byte_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 samples against their mean, as hex digits."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("k"), V.byte_fingerprint(F.col("embedding").cast("array<double>")).alias("fingerprint"))


@query("""WITH x AS (SELECT p_partkey AS k, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'red ring' ELSE 'other' END, ' ')) AS b FROM part)
  SELECT k, CASE WHEN k % 5 = 0 THEN 1 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END::DOUBLE AS queries, CASE WHEN k % 5 = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END::DOUBLE AS titles, len(list_intersect(a, b))::INTEGER AS shared, len(list_distinct(list_concat(a, b)))::INTEGER AS whole FROM x""")
def set_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word sets; two empty queries are equal, two empty titles are not."""
    k = F.col("p_partkey")
    other = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, "red  ring").otherwise("other")
    a, b = (F.when(k % 5 == 0, "").otherwise(x) for x in (F.col("p_name"), other))
    whole = T.words_of(F.col("p_name")), T.words_of(other)
    return table(spark, sf_dir, "part").select(k.alias("k"), F.round(T.query_jaccard(a, b), 6).alias("queries"), F.round(T.jaccard(T.title_tokens(a), T.title_tokens(b)), 6).alias("titles"), F.size(F.array_intersect(*whole)).alias("shared"), F.size(F.array_union(*whole)).alias("whole"))


@query("""WITH x AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS l, CASE WHEN p_partkey % 4 > 0 THEN 1 - 2 * (p_partkey % 3) / 64e0 ELSE 0 END AS p FROM part),
  s AS (SELECT k, p, CASE WHEN list_contains(l, 'red') AND list_contains(l, 'ring') THEN 1e0 WHEN list_contains(l, 'red') OR list_contains(l, 'ring') THEN 55e-2 / 3 + 45e-2 / 2 ELSE 0 END AS t FROM x),
  b AS (SELECT k, 32e-2 * t + 12e-2 * CASE WHEN k % 2 = 0 THEN 55e-2 / 2 + 45e-2 ELSE 0 END + 22e-2 * p + 14e-2 * CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 5e-1 ELSE 0 END + 8e-2 * CASE WHEN k % 6 = 0 THEN 1 ELSE 35e-2 * p END + 7e-2 * CASE k % 3 WHEN 0 THEN 4e-1 WHEN 1 THEN 1 ELSE 15e-2 END + 5e-2 * CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS r FROM s)
  SELECT k, round(round_even(CASE WHEN k % 5 = 0 THEN 85e-2 * r + 15e-2 * 9e-1 ELSE r END, 6), 5) AS recall FROM b""")
def cheap_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: seven signals and an embedding to one recall. Five digits, as recall is rounded to six by halves to even."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    words = lambda *x: F.array(*(F.lit(v) for v in x))
    half = lambda a, b: F.array(F.lit(a), F.lit(b))
    rows = p.select(
        k.alias("k"), words("red", "ring").alias("query_terms"), F.split(F.when(k % 7 == 0, F.concat("p_name", F.lit(""))).otherwise(F.col("p_name")), " ").alias("listing_terms"), F.when(k % 2 == 0, words("red")).otherwise(words("zz")).alias("ocr_terms"), F.lit("0000").alias("ref_hash"), F.when(k % 4 > 0, _one_of(k, "0000", "0f0f", "ffff")).alias("phash"),
        half(1.0, 0.0).alias("ref_histogram"), F.when(k % 3 == 0, half(1.0, 0.0)).when(k % 3 == 1, half(0.5, 0.5)).otherwise(half(0.0, 1.0)).alias("histogram"), F.lit("m").alias("ref_mask"), F.when(k % 6 == 0, "m").otherwise("n").alias("mask"), F.lit("shoe").alias("category"), F.when(k % 3 == 1, "shoe").when(k % 3 == 2, "bag").alias("listed_category"),
        F.when(k % 7 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise("Xyzzy Co").alias("brand"), F.when(k % 5 == 0, 0.9).alias("embedding"),
    )
    return matching.cheap_signals(rows).select("k", F.round("recall", 5).alias("recall"))


@query("""WITH r AS (SELECT o_orderkey AS k, round(o_totalprice / 4000000, 6) AS s FROM orders), t AS (SELECT * FROM r ORDER BY s DESC, k LIMIT 500) SELECT k, CASE WHEN s >= 0.12 THEN 'above_recall_threshold' ELSE 'recall_slack' END AS reason FROM t WHERE s >= 0.06""")
def broad_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4, M2: five hundred by recall, each with the reason for which it stays."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") / 4000000, 6).alias("s"))
    return ranking.broad_cut(rows, "s", "k").select("k", "reason")


@query("""WITH q AS (SELECT p_partkey AS k, 'Brand#' || (p_partkey % 5 + 1) || ' ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' black leather boots 2004' WHEN 1 THEN ' size 42 bag 97' WHEN 2 THEN ' 21 suede' ELSE ' for sale' END AS text FROM part)
  SELECT k, CASE k % 4 WHEN 0 THEN 2004 WHEN 1 THEN 1997 WHEN 2 THEN 2021 END::INTEGER AS year, CASE WHEN k % 4 = 0 THEN 'footwear' WHEN k % 4 = 1 THEN 'bag' WHEN p_name LIKE '%ring' THEN 'jewellery' END AS category_or_ring, CASE k % 4 WHEN 0 THEN 'leather' WHEN 2 THEN 'suede' END AS material, 'brand' AS brand FROM q JOIN part ON p_partkey = k WHERE k % 4 <> 3 AND p_name NOT LIKE '%ring'
  UNION ALL SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2004 WHEN 1 THEN 1997 WHEN 2 THEN 2021 END::INTEGER, 'jewellery', CASE p_partkey % 4 WHEN 0 THEN 'leather' WHEN 2 THEN 'suede' END, 'brand' FROM part WHERE p_partkey % 4 <> 3 AND p_name LIKE '%ring'
  UNION ALL SELECT p_partkey, NULL, CASE WHEN p_name LIKE '%ring' THEN 'jewellery' END, NULL, 'brand' FROM part WHERE p_partkey % 4 = 3""")
def requests_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of four digits before two, sizes passed over, categories and materials by their words, the brand first."""
    k = F.col("p_partkey")
    text = F.concat_ws(" ", F.lit("brand"), "p_name", _one_of(k, "black leather boots 2004", "size 42 bag 97", "21 suede", "for sale"))
    r = table(spark, sf_dir, "part").select(k.alias("k"), planning.request_of(text).alias("r"))
    return r.select("k", "r.year", F.col("r.category").alias("category_or_ring"), F.get("r.materials", 0).alias("material"), "r.brand")


@query("""WITH x AS (SELECT p_partkey AS search_id FROM part), v(id, w, model, year) AS (VALUES (0, 50, 'm', 97), (1, 25, 'm', NULL), (2, 15, NULL, 97), (3, 10, NULL, NULL))
  SELECT search_id, id::INTEGER AS id, CASE WHEN search_id % 2 = 0 THEN (w / 100)::DOUBLE END AS posterior FROM x, v WHERE search_id % 2 = 0 UNION ALL SELECT search_id, id, p FROM x, (VALUES (0, 0.65::DOUBLE), (1, 0.35::DOUBLE)) t(id, p) WHERE search_id % 2 = 1""")
def seeded_portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competing hypotheses of a request; those that say the same are one, and weights are shares."""
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select(k.alias("search_id"), F.when(k % 2 == 0, "guidi horse boots 97").otherwise("guidi boots 97").alias("text"))
    return planning.seed_portfolio(r).select("search_id", "id", "posterior")


@query("""WITH h AS (SELECT p_brand AS search_id, p_partkey AS id, p_retailprice / 2503 AS posterior, lower(p_brand) AS brand, p_name AS model, CASE WHEN p_partkey % 2 = 0 THEN 2004 END AS year, lower(p_type) AS category, CASE WHEN p_size % 3 = 0 THEN 'red' END AS colour, CASE WHEN p_size % 4 = 0 THEN 'wool' END AS material, CASE WHEN p_size % 5 = 0 THEN 'ab-1' END AS code, CASE WHEN p_size % 6 = 0 THEN 'aw04' END AS season FROM part),
  d AS (SELECT search_id, id, posterior, unnest([{'r': 0, 'c': 0, 'n': 1e0, 't': brand || ' ' || model}, {'r': 0, 'c': 0, 'n': 9e-1, 't': brand || ' ' || model || ' ' || year}, {'r': 1, 'c': 1, 'n': 8e-1, 't': brand || ' ' || category}, {'r': 1, 'c': 1, 'n': 7e-1, 't': brand || ' ' || model || ' ' || colour}, {'r': 2, 'c': 1, 'n': 6e-1, 't': brand || ' ' || material || ' ' || category}, {'r': 2, 'c': 0, 'n': 9e-1, 't': code},
    {'r': 3, 'c': 2, 'n': 5e-1, 't': colour || ' ' || material || ' ' || category}, {'r': 4, 'c': 2, 'n': 4e-1, 't': brand || ' ' || season || ' ' || category}, {'r': 5, 'c': 2, 'n': 3e-1, 't': brand || ' ' || model || ' replica'}]) AS q FROM h),
  o AS (SELECT search_id, q.t AS text, arg_min({'r': q.r, 'c': q.c, 'n': q.n, 'p': posterior, 'id': id}, (q.r, -posterior, id)) AS b FROM d WHERE q.t IS NOT NULL GROUP BY ALL),
  p AS (SELECT DISTINCT search_id, text AS past FROM o WHERE b.r = 1 AND b.id % 3 = 0),
  j AS (SELECT o.search_id, text, max(len(list_intersect(string_split(text, ' '), string_split(past, ' '))) / len(list_distinct(list_concat(string_split(text, ' '), string_split(past, ' '))))) AS ov FROM o JOIN p USING (search_id) GROUP BY ALL)
  SELECT o.search_id, o.text, b.id AS id, b.r::INTEGER AS round, round(coalesce(ov, 0), 6) AS overlap, round(round_even(b.p * b.n * (1 - coalesce(ov, 0)) * 65e-2 / (1 + b.c), 4), 3) AS gain FROM o LEFT JOIN j USING (search_id, text)""")
def drafted_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2, L3, L4: drafts of all rounds, with their overlap with what ran before. Three digits of the gain, which is rounded by halves to even."""
    s = lambda n, v, m: F.when(F.col("p_size") % m == 0, v).alias(n)
    h = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search_id"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2503).alias("posterior"), F.lower("p_brand").alias("brand"), F.col("p_name").alias("model"), F.when(F.col("p_partkey") % 2 == 0, 2004).alias("year"), F.lower("p_type").alias("category"), s("colour", "red", 3), s("material", "wool", 4), s("code", "AB-1", 5), s("season", "aw04", 6))
    d = planning.drafts(h)
    prior = d.where((F.col("round") == 1) & (F.col("id") % 3 == 0)).select("search_id", "text").distinct()
    return planning.with_gain(d, prior, F.lit(1)).select("search_id", "text", "id", "round", F.round("overlap", 6).alias("overlap"), F.round("gain", 3).alias("gain"))


@query("""SELECT p_brand AS search_id, p_name AS text, ['en', 'ja', 'fr'][p_size % 3 + 1] AS language FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size / 50e0 DESC, p_name, p_partkey) <= 0
  UNION ALL SELECT b, 'q' || i, l FROM (SELECT DISTINCT p_brand AS b FROM part), (VALUES (1, 'en'), (2, 'en'), (5, 'ja'), (6, 'fr')) t(i, l)""")
def repaired_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four places; each language gets its best query, and the weakest of a crowded one makes room."""
    chosen = [(1, "en", 0.9, 1.0), (2, "en", 0.8, 2.0), (3, "en", 0.7, 3.0), (4, "en", 0.6, 4.0), (5, "ja", 0.5, None), (6, "fr", 0.2, None), (7, "fr", 0.1, None), (8, "en", 0.95, None)]
    q = spark.createDataFrame([(f"q{i}", lang, g, p) for i, lang, g, p in chosen], "text string, language string, gain double, position double")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search_id")).distinct().join(F.broadcast(q))  # eight rows
    return ranking.language_repair(rows, "search_id", ["en", "ja", "fr"], 4).select("search_id", "text", "language")


@query("""SELECT p_brand AS search_id, 's' || (p_partkey % 7) || '-' || p_partkey AS image_id, count(*) OVER (PARTITION BY p_brand, p_partkey % 7) AS size, round(least(0.9, 0.4 + 0.15 * count(*) OVER (PARTITION BY p_brand, p_partkey % 7)), 6) AS confidence FROM part""")
def unified_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photographs of each search near in hash and in colour; seven kinds that are far from each other."""
    k = F.col("p_partkey")
    digit = F.conv((k % 7).cast("string"), 10, 16)
    shade = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.when(i == k % 7, 1.0).otherwise(0.0))
    near = F.when(k % 2 == 0, F.repeat(F.lower(digit), 16)).otherwise(F.concat(F.repeat(F.lower(digit), 13), F.lit("abc")))
    images = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search_id"), F.concat(F.lit("s"), (k % 7).cast("string"), F.lit("-"), k.cast("string")).alias("image_id"), near.alias("hash"), shade.alias("histogram"))
    out = matching.unify_references(images)
    return out.select("search_id", "image_id", "size", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {JUDGED_SQL} SELECT id AS candidate_id, label AS is_it_authentic, CASE WHEN live THEN 'yes' ELSE 'no' END AS is_it_available, CASE WHEN images > 1 THEN 'yes' ELSE 'no' END AS were_photos_screened, 10 AS questions FROM b""")
def reader_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten questions and their answers."""
    a = campaign.questions(judged(spark, sf_dir))
    one = lambda n: F.element_at("answers", F.lit(n)).alias(n)
    return a.select("candidate_id", one("is_it_authentic"), one("is_it_available"), one("were_photos_screened"), F.size("answers").alias("questions"))


@query(f"""WITH {JUDGED_SQL}, c AS (SELECT l_orderkey AS id, 'f' || l_linenumber AS field, ['support', 'contradiction', 'missing'][l_partkey % 3 + 1] AS v FROM lineitem)
  SELECT b.id AS candidate_id, list_sort(coalesce(list(field) FILTER (v = 'support'), [])) AS verified_fields, list_sort(coalesce(list(field) FILTER (v = 'contradiction'), [])) AS contradicted_fields, list_sort(coalesce(list(field) FILTER (v = 'missing'), [])) AS unseen_fields FROM b LEFT JOIN c ON c.id = b.id AND b.id % 3 > 0 GROUP BY b.id""")
def verified_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification found, beside each decision; fields once for every time they were checked."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 3 > 0)
    checks = li.select(F.col("l_orderkey").alias("candidate_id"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), _one_of(F.col("l_partkey"), "support", "contradiction", "missing").alias("verdict"))
    return campaign.with_verification(judged(spark, sf_dir), checks).select("candidate_id", "verified_fields", "contradicted_fields", "unseen_fields")


@query("""WITH RECURSIVE t AS (SELECT conv_id AS g, turn AS n, list_distinct(list_filter(string_split(trim(regexp_replace(translate(lower(trim(regexp_replace(text, '["''`]+', '', 'g'))), chr(9) || chr(10) || chr(13), '   '), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
  k AS (SELECT g, i, n, [w] AS kept, true AS ok FROM t WHERE i = 1
    UNION ALL SELECT t.g, t.i, t.n, CASE WHEN len(list_filter(k.kept, lambda o: (CASE WHEN len(o) = 0 AND len(t.w) = 0 THEN 1 ELSE len(list_intersect(o, t.w)) / len(list_distinct(list_concat(o, t.w))) END) >= 0.86)) = 0 THEN list_append(k.kept, t.w) ELSE k.kept END, len(list_filter(k.kept, lambda o: (CASE WHEN len(o) = 0 AND len(t.w) = 0 THEN 1 ELSE len(list_intersect(o, t.w)) / len(list_distinct(list_concat(o, t.w))) END) >= 0.86)) = 0 FROM k JOIN t ON t.g = k.g AND t.i = k.i + 1)
  SELECT g AS conv_id, n AS turn FROM k WHERE ok""")
def near_dup_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy in order of the turn, inside one conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return cluster.greedy_distinct(c, "conv_id", "text", "turn", 0.86).select("conv_id", "turn")


SHADE_SQL = """
  s AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 5e-1) * 255)))) AS g FROM embeddings WHERE len(embedding) = 64),
  m AS (SELECT vec_id, g, list_sum(g) / 64 AS mean FROM s)
"""


@query(f"""WITH {SHADE_SQL}, b AS (SELECT *, list_transform(g, lambda x: (x >= mean)::INTEGER) AS b FROM m)
  SELECT vec_id, array_to_string(list_transform(range(16), lambda i: substr('0123456789abcdef', (8 * b[i * 4 + 1] + 4 * b[i * 4 + 2] + 2 * b[i * 4 + 3] + b[i * 4 + 4] + 1)::BIGINT, 1)), '') AS phash,
    list_transform(range(24), lambda i: len(list_filter(g, lambda x: least(7, floor(x * 8 / 256)) = i % 8)) / 64) AS histogram, round(mean / 255, 6) AS exposure,
    round((list_sum(list_transform(range(56), lambda i: abs(g[i + 9] - g[i + 1]))) + list_sum(list_transform(list_filter(range(64), lambda i: i % 8 < 7), lambda i: abs(g[i + 2] - g[i + 1])))) / 112, 6) AS edge_mean FROM b""")
def image_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 read as grey images of 8 by 8 (there are no images in the tables): hash, colours, edges, exposure."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    shade = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 255))).cast("long")), 2, "0")), "")
    rows = e.select("vec_id", F.unhex(shade).alias("data"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    out = rows.select("vec_id", I.hash_of("data", "w", "h").alias("phash"), I.histogram_of("data", "w", "h").alias("histogram"), I.statistics_of("data", "w", "h").alias("s"))
    return out.select("vec_id", "phash", "histogram", F.round("s.exposure", 6).alias("exposure"), F.round("s.edge_mean", 6).alias("edge_mean"))


@query("""SELECT vec_id AS k, round(6e-1 * (1 - 2 * (vec_id % 3) / 64e0) + 4e-1 * 5e-1, 6) AS cheap, CASE WHEN vec_id % 2 = 0 THEN 'embedding' ELSE 'cheap' END AS scorer, round(CASE WHEN vec_id % 2 = 0 THEN 9e-1 ELSE 6e-1 * (1 - 2 * (vec_id % 3) / 64e0) + 4e-1 * 5e-1 END, 6) AS score FROM embeddings""")
def scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A similarity without embeddings, and which of two counts."""
    k = F.col("vec_id")
    cheap = S.cheap_visual(F.lit("0000"), _one_of(k, "0000", "0f0f", "ffff"), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.5)))
    rows = table(spark, sf_dir, "embeddings").select(k.alias("k"), cheap.alias("cheap"), S.scorer(F.when(k % 2 == 0, 0.9), cheap).alias("s"))
    return rows.select("k", F.round("cheap", 6).alias("cheap"), F.col("s.scorer").alias("scorer"), F.round("s.score", 6).alias("score"))


@query("""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'footwear' WHEN 1 THEN 'garment' WHEN 2 THEN 'generic:bag' WHEN 3 THEN 'generic:unknown' ELSE 'footwear' END AS profile FROM part""")
def category_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile that a category is judged by."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), A.profile_of(_one_of(k, " Sneaker ", "long-sleeve", "Bag", "", "generic:shoe")).alias("profile"))


@query("""WITH g AS (SELECT l_orderkey AS search_id, 'v' || (l_partkey % 9) AS view, max(l_discount) AS gain FROM lineitem WHERE l_linenumber > 1 AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = lineitem.l_orderkey AND r.l_linenumber = 1 AND r.l_partkey % 9 = lineitem.l_partkey % 9) GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY gain DESC, view)::INTEGER AS turn FROM g) SELECT * FROM t WHERE turn <= 2""")
def replanned_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views still missing become the next queries, two a search."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("search_id"), F.concat(F.lit("v"), (F.col("l_partkey") % 9).cast("string")).alias("view"), F.col("l_discount").alias("gain"), "l_linenumber")
    return planning.replanned(li.where(F.col("l_linenumber") > 1), li.where(F.col("l_linenumber") == 1), 2).select("search_id", "view", "gain", "turn")


@query(f"""WITH {JUDGED_SQL}, t AS (SELECT CASE WHEN id % 3 = 0 THEN 'HIDDEN' ELSE bucket END AS truth, bucket AS predicted FROM b),
  g AS (SELECT x AS truth, y AS predicted FROM (VALUES ('REAL'), ('POSSIBLY_REAL'), ('REPLICA'), ('HIDDEN')) a(x), (VALUES ('REAL'), ('POSSIBLY_REAL'), ('REPLICA'), ('HIDDEN')) b(y))
  SELECT g.truth, g.predicted, count(t.truth) AS n FROM g LEFT JOIN t USING (truth, predicted) GROUP BY ALL""")
def bucket_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: candidates judged end to end against labels, as a confusion over the tabs."""
    rows = judged(spark, sf_dir).select(F.when(F.col("candidate_id") % 3 == 0, "HIDDEN").otherwise(F.col("bucket")).alias("truth"), F.col("bucket").alias("predicted"))
    return metrics.confusion(rows, "truth", "predicted", ["REAL", "POSSIBLY_REAL", "REPLICA", "HIDDEN"])


@query("SELECT count(*) AS written, 0::BIGINT AS broken, 1::BIGINT AS tampered FROM (SELECT DISTINCT p_brand FROM part)")
def written_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of a run written as JSON, read back and verified; one is changed and found."""
    path = f"{cluster.checkpoint_dir(spark)}/receipts-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("case")).agg(F.count(F.lit(1)).cast("string").alias("n")).withColumn("receipt_type", F.lit("BenchmarkReceipt"))
    columns = ["case", "n", "receipt_type"]
    R.sealed(rows, columns).write.json(path)
    back = spark.read.schema("case string, n string, receipt_type string, digest string").json(path)
    first = back.agg(F.min("case").alias("least"))
    changed = back.join(F.broadcast(first)).withColumn("n", F.when(F.col("case") == F.col("least"), "0").otherwise(F.col("n")))  # one row
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(back, "written").join(F.broadcast(count(R.broken(back, columns), "broken"))).join(F.broadcast(count(R.broken(changed, columns), "tampered")))  # one row each


@query("SELECT page_id, length(html) AS chars, row_number() OVER (PARTITION BY split_part(split_part(url, '/', 3), '?', 1) ORDER BY page_id) AS nth FROM pages")
def paged_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host's pages taken in order, in one place."""

    def make() -> object:
        seen: dict[str, int] = {}

        def f(row: dict) -> int:
            seen[row["host"]] = seen.get(row["host"], 0) + 1
            return seen[row["host"]]

        return f

    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.char_length("html").cast("long").alias("chars"))
    return planning.map_by_host(p, "host", "page_id", make, "nth", "long").select("page_id", "chars", "nth")


@query("""WITH m AS (
    SELECT p_partkey AS id, unnest(range(CASE WHEN p_size > 45 THEN 2 ELSE 12 END)) AS pos, p_partkey AS k FROM part),
  g AS (
    SELECT id, pos, ((k * 7 + pos * 13) % 64)::DOUBLE AS x, ((k * 3 + pos * 29) % 48)::DOUBLE AS y, CASE WHEN k % 11 = 0 THEN 5.0 ELSE [1.0, 0.5, 2.0][k % 3 + 1] END::DOUBLE AS s, k FROM m),
  h AS (SELECT id, pos, x, y, (CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END) * (s * x + k % 17 + CASE WHEN pos % 4 = 3 THEN 100 + pos * 17 ELSE 0 END)::DOUBLE AS u, (s * y - k % 5)::DOUBLE AS v, count(*) OVER (PARTITION BY id) AS n FROM g),
  r AS (
    SELECT f.flip, seed, a.id, a.n, a.x AS x1, a.y AS y1, f.flip * a.u AS u1, a.v AS v1, sqrt(((f.flip * b.u - f.flip * a.u) ** 2 + (b.v - a.v) ** 2) / ((b.x - a.x) ** 2 + (b.y - a.y) ** 2)) AS scale
    FROM (SELECT unnest([1, -1]) AS flip) f, (SELECT unnest(range(64)) AS seed) q, h a JOIN h b ON a.id = b.id
    WHERE a.n >= 3 AND a.pos = seed % a.n AND b.pos = (seed * 3 + 1) % a.n AND a.pos <> b.pos AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 >= 4),
  e AS (
    SELECT r.id, r.flip, r.seed, sqrt((scale * h.x + u1 - scale * x1 - flip * h.u) ** 2 + (scale * h.y + v1 - scale * y1 - h.v) ** 2) AS err
    FROM r JOIN h ON h.id = r.id WHERE scale BETWEEN 0.3 AND 3.2),
  c AS (SELECT id, flip, seed, count(*) FILTER (err <= 8) AS hits, avg(err) FILTER (err <= 8) AS residual FROM e GROUP BY ALL),
  best AS (SELECT * FROM c WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, flip DESC, seed) = 1)
  SELECT i.id AS pair_id, i.n AS matches, coalesce(hits, 0) AS inliers, coalesce(round(residual, 6), 99) AS residual, coalesce(flip = -1, false) AS mirrored FROM (SELECT DISTINCT id, n FROM h) i LEFT JOIN best USING (id)""")
def agreeing_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale and shift that most matches of a pair agree on, by fixed rounds, within eight pixels."""
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(k, F.explode(F.sequence(F.lit(0), F.when(F.col("p_size") > 45, 1).otherwise(11))).alias("at"))
    x, y, at = ((k * 7 + F.col("at") * 13) % 64).cast("double"), ((k * 3 + F.col("at") * 29) % 48).cast("double"), F.col("at")
    s = F.when(k % 11 == 0, 5.0).when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.5).otherwise(2.0)
    u = F.when(k % 2 == 1, -1).otherwise(1) * (s * x + k % 17 + F.when(at % 4 == 3, 100 + at * 17).otherwise(0))
    out = keypoints.fitted(m.select(k.alias("pair_id"), "at", x.alias("x"), y.alias("y"), u.cast("double").alias("u"), (s * y - k % 5).alias("v")))
    return out.select("pair_id", "matches", "inliers", F.round("residual", 6).alias("residual"), "mirrored")
