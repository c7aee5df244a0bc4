"""A campaign end to end over columns: normalise, judge, replay, publish."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import money as M
from quarry.functions import scores as S
from quarry.functions import url as U
from quarry.operators import cluster, ranking


def provenance(value: Column, original: Column, method: str, confidence: float, origin: str = "EXTRACTOR") -> Column:
    """A field with where it came from; null without a value."""
    kind = "REPORTED_BY_SELLER" if origin == "SELLER" else "EXTRACTED"
    return F.when(value.isNotNull(), F.struct(value.cast("string").alias("value"), original.cast("string").alias("original"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("fact_class"), F.lit(origin).alias("origin")))


def normalise(raw: DataFrame) -> DataFrame:
    """raw(source_id, url, title, description, price, currency, size, availability) to candidates; originals stay beside."""
    price, hint = F.coalesce("price", F.lit("")), F.col("currency")
    size = M.size(F.col("size"))
    rows = raw.select(
        "source_id", F.col("url").alias("original_url"), U.canonical_url(F.col("url")).alias("canonical_url"), U.listing_id(F.col("url")).alias("listing_id"), H.strip_html(F.col("title")).alias("title"),
        H.strip_html(F.col("description")).alias("description"), M.amount(price, hint).alias("price"), M.currency(price, hint).alias("currency"), size.alias("size"), H.availability(F.col("availability")).alias("availability"),
        F.col("price").alias("_price"), F.col("size").alias("_size"), F.col("availability").alias("_availability"),
    )
    fields = F.create_map(
        F.lit("price"), provenance(F.col("price"), F.col("_price"), "price_text", 0.8, "SELLER"), F.lit("size"), provenance(F.col("size.marked"), F.col("_size"), "size_text", 0.7, "SELLER"), F.lit("availability"), provenance(F.col("availability"), F.col("_availability"), "state_words", 0.9),
    )
    keyed = rows.withColumn("field_records", fields).withColumn("cluster_key", cluster.cluster_key(F.col("source_id"), F.col("listing_id"), F.col("canonical_url")))
    return keyed.withColumn("candidate_id", F.sha2("cluster_key", 256)).drop("_price", "_size", "_availability")


#: Gates by policy version: least item, authenticity and completeness; whether calibration and a live page are demanded.
POLICIES = {"matching-1": (0.90, 0.80, 0.65, True, True), "provisional-1": (0.90, 0.80, 0.65, False, False)}


def judge(rows: DataFrame, version: str = "matching-1") -> DataFrame:
    """bucket, reasons and vetoes of candidates.

    rows: candidate_id, item_match and authenticity (intervals), calibrated, completeness, live, verified, hard_item,
    hard_auth (counts), scam, stolen, screened, malicious, replica, link.
    """
    item, auth, complete, need_cal, need_live = POLICIES[version]
    veto = S.hard_vetoes([
        ("item_contradiction", F.col("hard_item") > 0), ("authenticity_contradiction", F.col("hard_auth") > 0), ("malicious_url", F.col("malicious")), ("scam_signal", F.col("scam")), ("stolen_photo", F.col("stolen")),
        ("dead_listing", F.lit(need_live) & ~F.col("live")),
    ])
    auth_lower = S.screened(F.col("authenticity.lower_bound"), F.col("screened"), auth)
    checks = [("item_match_low", F.col("item_match.lower_bound") < item), ("authenticity_low", auth_lower < auth), ("incomplete", F.col("completeness") < complete), ("not_live", ~F.col("live")), ("unverified", ~F.col("verified")), ("uncalibrated", F.lit(need_cal) & ~F.col("calibrated"))]
    reasons = F.array_compact(F.array(*(F.when(c, n) for n, c in checks)))
    rows = rows.withColumn("vetoes", veto).withColumn("reasons", F.concat(F.col("vetoes"), reasons))
    real = F.size("reasons") == 0
    maybe = S.possibly_gate(F.col("item_match.lower_bound"), F.col("hard_item"), F.col("hard_auth"), F.col("scam"), F.col("vetoes"))
    out = rows.withColumn("bucket", S.bucket(real, maybe, F.col("replica"), F.col("link")))
    return out.withColumn("label", S.public_label(F.col("calibrated"), F.col("hard_auth"), F.col("completeness"), F.col("authenticity.lower_bound"))).withColumn("policy_version", F.lit(version))


def never_raised(before: Column, after: Column) -> Column:
    """An interval copied or recomputed later keeps every bound at or below what it was."""
    return F.struct(*(F.least(before[c], after[c]).alias(c) for c in ("mean", "lower_bound", "upper_bound")))


def replay(hits: DataFrame, evidence: DataFrame, version: str = "matching-1") -> DataFrame:
    """Index hits with their stored intervals as they are, judged again; photographs were not screened, so none is real."""
    return judge(hits.join(evidence, "listing_key").withColumn("screened", F.lit(False)), version)


def consult(hits: DataFrame, listings: DataFrame, known_urls: DataFrame, now: Column, ttl: int = 6 * 3600) -> DataFrame:
    """Hits with their listings, those whose URL the campaign has left out, stale states unknown."""
    rows = hits.join(listings, "listing_key").join(known_urls, "canonical_url", "left_anti")
    return rows.withColumn("availability", S.present_availability(F.col("availability"), F.col("last_checked_at"), now, ttl))


def publish(decisions: DataFrame) -> DataFrame:
    """bucket, rank, place: ranked by each tab's keys, first of each family before repeats."""
    real, maybe = F.col("bucket") == "REAL", F.col("bucket") == "POSSIBLY_REAL"
    # each tab's n-th key in one column: decisions are made once, and dealt by all tabs at once
    keys = [F.when(real, r).when(maybe, m).otherwise(o) for r, m, o in zip_longest(ranking.real_keys(), ranking.possibly_keys(), [F.col("item_lower")], fillvalue=F.lit(None))]
    return ranking.diversify(ranking.rank_tab(decisions.where(F.col("bucket").isNotNull()), "bucket", keys, "candidate_id"), "bucket", "family")


# fixed values: outcomes of a source that leave the search open
UNRESOLVED = ["NETWORK_FAILED", "PARSER_FAILED", "RATE_LIMITED", "SOURCE_UNAVAILABLE", "UNMEASURABLE", "NOT_ATTEMPTED"]


def terminal_status(proposed: Column, pages: Column, candidates: Column, queries: Column, saturated: Column, outcomes: Column) -> Column:
    """COMPLETE is a claim of coverage: it needs queries, something fetched or found, and an answer of every source, unless enough was found."""
    open_ = F.coalesce(F.exists(outcomes, lambda o: o.isin(UNRESOLVED)), F.lit(False))
    return (
        F.when((proposed != "COMPLETE") | saturated, proposed).when(F.coalesce(queries <= 0, F.lit(False)), "BLOCKED")
        .when((pages <= 0) & (candidates <= 0), "BLOCKED").when(open_, "PARTIAL").otherwise(proposed)
    )


def score_pairs(scores: DataFrame) -> DataFrame:
    """scores(candidate_id, kind, seq, fine, score) to candidate_id, item_match, match_fine, authenticity, utility, remembered.

    Of item matches the last fine one counts, else the first broad one; of the other kinds the last. `remembered` is the
    match that an index may keep: a fine one.
    """
    kind = F.col("kind")
    last = lambda c, name: F.max_by("score", F.when(c, F.col("seq"))).alias(name)
    match = kind == "ITEM_MATCH"
    rows = scores.groupBy("candidate_id").agg(last(match & F.col("fine"), "remembered"), F.min_by("score", F.when(match & ~F.col("fine"), F.col("seq"))).alias("_broad"), last(kind == "AUTHENTICITY_CONFIDENCE", "authenticity"), last(kind == "LISTING_UTILITY", "utility"), F.coalesce(F.bool_or(match & F.col("fine")), F.lit(False)).alias("match_fine"))
    return rows.select("candidate_id", F.coalesce("remembered", "_broad").alias("item_match"), "match_fine", "authenticity", "utility", "remembered")


def exhaustion(runs: DataFrame, search: str) -> DataFrame:
    """What a search went through: counts, and its families and languages in order."""
    names = lambda c: F.sort_array(F.collect_set(c))
    return runs.groupBy(search).agg(F.count(F.lit(1)).alias("runs"), F.sum("pages").alias("pages"), F.count_if(F.col("outcome").isin(UNRESOLVED)).alias("unresolved"), names("family").alias("families"), names("language").alias("languages"))


def questions(rows: DataFrame) -> DataFrame:
    """What a reader asks of a result, as a map."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    asked = {
        "is_it_the_item": F.col("item_match.lower_bound").cast("string"), "is_it_authentic": F.col("label"), "is_it_available": yes(F.col("live")), "was_the_page_checked": yes(F.col("verified")), "what_contradicts": F.array_join("vetoes", ", "),
        "what_is_missing": F.array_join("reasons", ", "), "is_it_calibrated": yes(F.col("calibrated")), "were_photos_screened": yes(F.col("screened")), "does_it_say_replica": yes(F.col("replica")), "which_policy": F.col("policy_version"),
    }
    return rows.withColumn("answers", F.create_map(*(x for k, v in asked.items() for x in (F.lit(k), v))))


def with_verification(decisions: DataFrame, checks: DataFrame) -> DataFrame:
    """Decisions with what verification found: support, contradictions and gaps by field."""
    verdict = lambda v: F.sort_array(F.collect_list(F.when(F.col("verdict") == v, F.col("field"))))
    found = checks.groupBy("candidate_id").agg(verdict("support").alias("verified_fields"), verdict("contradiction").alias("contradicted_fields"), verdict("missing").alias("unseen_fields"))
    none = F.array().cast("array<string>")
    return decisions.join(found, "candidate_id", "left").withColumns({c: F.coalesce(c, none) for c in ("verified_fields", "contradicted_fields", "unseen_fields")})
