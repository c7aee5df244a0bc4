"""Campaigns over the tables: normalise, plan, judge, replay, publish, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.operators import campaign, matching, planning
from quarry.plans.registry import query, table
from quarry.plans.scoring import CANDIDATE_SQL, candidates


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    return p.select(
        F.lit("feed").alias("source_id"), F.concat(F.lit("HTTPS://Shop.example/products/"), key, F.lit("/?utm_source=a&v=2")).alias("url"), F.concat(F.lit("<b>"), "p_name", F.lit("</b> &amp; more")).alias("title"), F.col("p_type").alias("description"),
        F.concat(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit(" EUR")).alias("price"), F.lit(None).cast("string").alias("currency"), F.concat(F.lit("EU "), (30 + F.col("p_size") % 20).cast("string")).alias("size"), F.when(F.col("p_size") % 2 == 0, "InStock").otherwise("sold").alias("availability"),
    )


@query("""SELECT p_partkey::VARCHAR AS listing_id, 'https://shop.example/products/' || p_partkey || '?v=2' AS canonical_url, p_name || ' & more' AS title, p_retailprice::DECIMAL(18,2)::DOUBLE AS price, 'EUR' AS currency, 'EU' AS size_system, CASE WHEN p_size % 2 = 0 THEN 'LIVE' ELSE 'SOLD' END AS availability, sha256('feed:' || p_partkey) AS candidate_id FROM part""")
def normalised_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18, C19, K1, K9."""
    n = campaign.normalise(_raw(spark, sf_dir))
    return n.select("listing_id", "canonical_url", "title", F.col("price").cast("double").alias("price"), "currency", F.col("size.system").alias("size_system"), "availability", "candidate_id")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, f = candidates(spark, sf_dir), F.lit(False)
    iv = lambda low: F.struct(F.greatest(F.col(low), F.lit(0.0)).alias("mean"), F.col(low).alias("lower_bound"), F.lit(1.0).alias("upper_bound"))
    rows = c.select(
        F.col("id").alias("candidate_id"), "family", iv("item_lower").alias("item_match"), iv("auth_lower").alias("authenticity"), (F.col("sellers") >= 2).alias("calibrated"), "completeness", "live", F.lit(True).alias("verified"), F.lit(0).alias("hard_item"),
        (F.col("sellers") >= 7).cast("int").alias("hard_auth"), "scam", (F.col("sellers") >= 6).alias("stolen"), (F.col("images") > 1).alias("screened"), f.alias("malicious"), (F.col("family") % 49 == 0).alias("replica"), (F.col("family") % 50 != 0).alias("link"),
        "item_lower", "auth_lower", F.lit(1.0).alias("size_match"), F.least(F.lit(1.0), F.col("images") / 4).alias("coverage"), F.lit(0.5).alias("price_fit"),
    )
    return campaign.judge(rows)


JUDGED_SQL = f"""{CANDIDATE_SQL},
  j AS (SELECT *, sellers >= 2 AS cal, (sellers >= 7)::INTEGER AS ha, CASE WHEN images > 1 THEN auth_lower ELSE least(auth_lower, 0.79) END AS al FROM cand),
  v AS (SELECT *, ha > 0 OR scam OR sellers >= 6 OR NOT live AS veto FROM j),
  b AS (SELECT *, CASE WHEN family % 50 = 0 THEN 'HIDDEN' WHEN family % 49 = 0 THEN 'REPLICA'
    WHEN NOT veto AND item_lower >= 0.9 AND al >= 0.8 AND completeness >= 0.65 AND live AND cal THEN 'REAL' WHEN item_lower >= 0.45 AND ha = 0 AND NOT scam AND NOT veto THEN 'POSSIBLY_REAL' ELSE 'HIDDEN' END AS bucket,
    CASE WHEN NOT cal THEN 'INCOMPLETE' WHEN ha > 0 THEN 'CONTRADICTORY' WHEN completeness < 0.5 THEN 'INCOMPLETE' WHEN auth_lower >= 0.8 THEN 'HIGH' WHEN auth_lower >= 0.5 THEN 'MODERATE' ELSE 'INCOMPLETE' END AS label FROM v)"""


@query(f"WITH {JUDGED_SQL} SELECT id AS candidate_id, bucket, label FROM b")
def judged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged end to end under one policy."""
    return judged(spark, sf_dir).select("candidate_id", "bucket", "label")


@query(f"""WITH {JUDGED_SQL},
  r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY item_lower DESC, CASE bucket WHEN 'REAL' THEN auth_lower WHEN 'POSSIBLY_REAL' THEN 1 - completeness END DESC, CASE bucket WHEN 'REAL' THEN completeness WHEN 'POSSIBLY_REAL' THEN auth_lower END DESC, CASE WHEN bucket IN ('REAL', 'POSSIBLY_REAL') THEN live END DESC, CASE WHEN bucket IN ('REAL', 'POSSIBLY_REAL') THEN least(1, images / 4) END DESC, id)::INTEGER AS rank FROM b),
  n AS (SELECT *, row_number() OVER (PARTITION BY bucket, family ORDER BY rank) > 1 AS again FROM r)
  SELECT id AS candidate_id, bucket, rank, row_number() OVER (PARTITION BY bucket ORDER BY again, rank)::INTEGER AS place FROM n""")
def published_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9, H10, G1, G2, G8, O4."""
    keys = ["item_lower", "auth_lower", "completeness", "live", "size_match", "coverage", "price_fit"]
    return campaign.publish(judged(spark, sf_dir).select("candidate_id", "bucket", "family", *keys)).select("candidate_id", "bucket", "rank", "place")


@query(f"""WITH {CANDIDATE_SQL}, k AS (SELECT *, id % 7 <> 0 AS fresh FROM cand WHERE id % 3 <> 0)
  SELECT id AS candidate_id, CASE WHEN id % 7 = 0 THEN 'UNKNOWN' WHEN live THEN 'LIVE' ELSE 'SOLD' END AS availability, least(item_lower, 0.9) AS lower_bound,
    CASE WHEN live AND NOT scam AND sellers < 6 AND sellers < 7 AND least(item_lower, 0.9) >= 0.45 THEN 'POSSIBLY_REAL' ELSE 'HIDDEN' END AS bucket FROM k""")
def replayed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the index whose URL is new, with states that go stale, judged on stored intervals that never rise; unscreened, so none is real."""
    c = candidates(spark, sf_dir)
    now, url = F.to_timestamp(F.lit("2024-01-02 00:00:00")), F.concat(F.lit("https://x.example/"), F.col("id").cast("string"))
    listings = c.select(F.col("id").alias("listing_key"), url.alias("canonical_url"), F.when(F.col("live"), "LIVE").otherwise("SOLD").alias("availability"), (now - F.when(F.col("id") % 7 == 0, F.expr("INTERVAL 6 HOURS 1 SECOND")).otherwise(F.expr("INTERVAL 6 HOURS"))).alias("last_checked_at"))
    known = listings.where(F.col("listing_key") % 3 == 0).select("canonical_url")
    hits = campaign.consult(c.select(F.col("id").alias("listing_key")), listings, known, now)
    iv = lambda low: F.struct(F.greatest(low, F.lit(0.0)).alias("mean"), low.alias("lower_bound"), F.lit(1.0).alias("upper_bound"))
    stored = campaign.never_raised(iv(F.lit(0.9)), iv(F.col("item_lower")))
    evidence = c.select(F.col("id").alias("listing_key"), F.col("id").alias("candidate_id"), stored.alias("item_match"), iv(F.lit(0.95)).alias("authenticity"), F.lit(True).alias("calibrated"), F.lit(0.9).alias("completeness"), "live", F.lit(True).alias("verified"), F.lit(0).alias("hard_item"), (F.col("sellers") >= 7).cast("int").alias("hard_auth"), "scam", (F.col("sellers") >= 6).alias("stolen"), *(F.lit(x).alias(n) for n, x in (("malicious", False), ("replica", False), ("link", True))))
    return campaign.replay(hits, evidence).select("candidate_id", "availability", "item_match.lower_bound", "bucket")


@query("""WITH h AS (SELECT p_brand AS search_id, p_partkey AS id, lower(p_brand) AS brand, p_name AS model, p_type AS category FROM part), j AS (SELECT a.search_id, a.brand = b.brand AS sb, a.model = b.model AS sm, a.category = b.category AS sc FROM h a JOIN h b ON a.search_id = b.search_id AND a.id < b.id)
  SELECT search_id, kind, count(*) AS n FROM (SELECT search_id, CASE WHEN sb AND sm THEN 'same_item' WHEN sb THEN 'same_brand' WHEN sc THEN 'competes' END AS kind FROM j) WHERE kind IS NOT NULL GROUP BY ALL""")
def hypothesis_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of hypotheses of a search by kind, counted from kinds and not by pairing hypotheses."""
    h = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search_id"), F.col("p_partkey").alias("id"), F.lower("p_brand").alias("brand"), F.col("p_name").alias("model"), F.col("p_type").alias("category"))
    return matching.hypothesis_graph(h).groupBy("search_id", "kind").agg(F.sum("pairs").alias("n"))


@query("""WITH q AS (SELECT p_brand AS search_id, p_partkey AS id, p_retailprice / 2503 AS posterior, lower(p_brand || ' ' || p_name) AS text FROM part),
  o AS (SELECT search_id, text, arg_min(id, (-posterior, id)) AS id, max(posterior) AS posterior FROM q GROUP BY ALL)
  SELECT search_id, text, id, round_even(posterior * 1.0 * 0.65 / 1, 4) AS gain FROM o""")
def drafted_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2, L3, L4: drafts of round 0 with their gain when nothing ran before."""
    none = lambda n, k="string": F.lit(None).cast(k).alias(n)
    h = table(spark, sf_dir, "part").select(F.col("p_brand").alias("search_id"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2503).alias("posterior"), F.lower("p_brand").alias("brand"), F.col("p_name").alias("model"), none("year", "int"), none("category"), none("colour"), none("material"), none("code"), none("season"))
    d = planning.drafts(h).where(F.col("round") == 0)
    prior = d.where(F.lit(False)).select("search_id", "text")
    return planning.with_gain(d, prior, F.lit(1)).select("search_id", "text", "id", "gain")


@query("""SELECT p_partkey, ['front', 'back', 'sole', 'label'][1 + p_size % 2 : 4] AS gaps, round_even(0.6 * ((p_size % 4 + 1) / 4) + 0.4 * (least(p_size % 4 + 1, 2) / 2), 4) AS completeness FROM part""")
def view_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F28, I5, L12."""
    views = ["front", "back", "sole", "label"]
    expected, critical = F.array(*(F.lit(v) for v in views)), F.array(F.lit("front"), F.lit("back"))
    present = F.slice(expected, F.lit(1), F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", planning.evidence_gaps(views, F.slice(expected, F.lit(1), F.col("p_size") % 2)).alias("gaps"), S.view_completeness(expected, critical, present).alias("completeness"))


@query("""WITH s AS (SELECT l_partkey AS candidate_id, l_suppkey % 5 AS view, l_discount * 10 AS sm FROM lineitem), e AS (SELECT candidate_id, view, max(sm) - min(sm) AS d FROM s GROUP BY ALL) SELECT candidate_id, bool_or(d > 0.45) AS gap FROM e GROUP BY 1""")
def stock_photo_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F29, N11."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("candidate_id"), (F.col("l_suppkey") % 5).alias("view"), (F.col("l_discount") * 10).alias("smoothness"))
    return matching.stock_photo_gap(d)


@query("""WITH p AS (SELECT l_partkey AS candidate_id, l_discount * 2 AS d, l_suppkey % 2 = 0 AS exact FROM lineitem),
  c AS (SELECT candidate_id, CASE WHEN exact AND d > 0.07 THEN least(greatest(0, 1 - 3.2 * d), 0.25) END AS h, CASE WHEN exact AND d > 0.07 THEN least(greatest(0, 1 - 3.2 * d), 0.25) WHEN d > 0.12 THEN least(greatest(0, 1 - 3.2 * d), 0.45) ELSE greatest(0, 1 - 3.2 * d) END AS s FROM p)
  SELECT candidate_id, round(coalesce(min(h), max(s)), 6) AS colour, min(h) IS NOT NULL AS hard FROM c GROUP BY 1""")
def colour_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hard contradiction of any pair wins."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("candidate_id"), (F.col("l_discount") * 2).alias("colour_distance"), (F.col("l_suppkey") % 2 == 0).alias("exact"))
    return matching.colour_across(p, F.col("exact")).select("candidate_id", F.round("colour", 6).alias("colour"), F.coalesce(F.col("contradiction") == "hard", F.lit(False)).alias("hard"))


@query("""SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'DISABLED' WHEN page_id % 6 = 1 THEN 'BLOCKED_BY_ACCESS' WHEN page_id % 6 = 2 THEN 'BLOCKED_BY_POLICY' WHEN NOT regexp_matches(url, '^[a-z]+://[^/?#]+/(en|fr)') THEN 'BLOCKED_BY_POLICY' WHEN page_id % 6 = 3 THEN 'BLOCKED_BY_POLICY' WHEN page_id % 6 = 4 AND regexp_matches(url, '^[a-z]+://[^/?#]+/fr') THEN 'BLOCKED_BY_POLICY' ELSE 'ADMITTED' END AS outcome FROM pages""")
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file that could not be read forbids."""
    k = F.col("page_id") % 6
    urls = table(spark, sf_dir, "pages").select("page_id", F.when(k == 2, "http://10.0.0.1/en").otherwise(F.col("url")).alias("url"), (k != 0).alias("enabled"), (k == 1).alias("blocked"), F.array(F.lit("/en"), F.lit("/fr")).alias("prefixes"), F.when(k == 3, None).when(k == 4, "User-agent: *\nDisallow: /fr\n").otherwise("User-agent: *\nDisallow: /fr\nAllow: /fr/\n").alias("robots"))
    return planning.admission(urls).select("page_id", "outcome")
