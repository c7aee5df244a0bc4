"""Intervals, gates and weights of the three judgments as columns. An interval is a struct of mean, lower_bound, upper_bound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.money import weighted_mean
from quarry.functions.text import clamp
from quarry.functions.vectors import hash_similarity, histogram_similarity


def interval(mean: Column, lower: Column, upper: Column) -> Column:
    return F.struct(F.bround(mean, 6).alias("mean"), F.bround(lower, 6).alias("lower_bound"), F.bround(upper, 6).alias("upper_bound"))


def spread_interval(mean: Column, spread: Column) -> Column:
    m = clamp(mean)
    return interval(m, clamp(m - spread), clamp(m + 0.55 * spread))


def evidence_interval(supporting: Column, contradicting: Column, missing: Column, hard: Column) -> Column:
    """From the mean weight of support and counts of the rest."""
    mean = clamp(F.coalesce(supporting, F.lit(0.0)) - 0.12 * contradicting - 0.04 * missing - 0.25 * hard)
    spread = F.least(F.lit(0.45), 0.08 + 0.05 * missing + 0.04 * contradicting)
    return interval(mean, F.greatest(F.lit(0.0), mean - spread), F.least(F.lit(1.0), mean + 0.6 * spread))


def removal_guard(new: Column, old: Column) -> Column:
    """Taking evidence away never raises the lower bound."""
    raised = new["lower_bound"] > old["lower_bound"]
    mean = F.least(new["mean"], old["mean"])
    return F.when(raised, interval(mean, old["lower_bound"], F.greatest(new["upper_bound"], old["lower_bound"], mean))).otherwise(new)


def hard_penalty(iv: Column, hard: Column) -> Column:
    mean = F.least(iv["mean"], F.lit(0.22))
    return F.when(hard > 0, interval(mean, F.least(iv["lower_bound"], F.lit(0.12)), F.least(iv["upper_bound"], F.greatest(mean, F.lit(0.35))))).otherwise(iv)


def recall_score(text: Column, ocr: Column, perceptual: Column, colour: Column, silhouette: Column, category: Column, brand: Column, embedding: Column | None = None) -> Column:
    base = 0.32 * text + 0.12 * ocr + 0.22 * perceptual + 0.14 * colour + 0.08 * silhouette + 0.07 * category + 0.05 * brand
    blended = base if embedding is None else F.when(embedding.isNull(), base).otherwise(0.85 * base + 0.15 * embedding)
    return F.bround(clamp(blended), 6)


def silhouette_signal(own: Column, other: Column, perceptual: Column) -> Column:
    return F.when(own == other, F.lit(1.0)).otherwise(0.35 * perceptual)


def category_signal(wanted: Column, listed: Column) -> Column:
    return F.when(listed.isNull(), F.lit(0.4)).when(wanted == listed, F.lit(1.0)).otherwise(0.15)


def brand_signal(brand: Column, listing_terms: Column) -> Column:
    first = F.lower(F.substring_index(F.trim(brand), " ", 1))
    return F.when((first != "") & F.array_join(listing_terms, " ").contains(first), F.lit(1.0)).otherwise(0.0)


def global_visual(perceptual: Column, colour: Column, aspect: Column) -> Column:
    return 0.5 * perceptual + 0.3 * colour + 0.2 * aspect


def blended_visual(visual: Column, similarity: Column) -> Column:
    return F.when(similarity.isNull(), visual).when(similarity >= 0.86, 0.35 * visual + 0.65 * similarity).otherwise(0.9 * visual + 0.1 * similarity)


def colour_consistency(distance: Column, exact: Column) -> Column:
    """Struct of score and whether it contradicts: hard, soft or null. Distance is Euclidean over the largest possible."""
    score = F.greatest(F.lit(0.0), 1 - 3.2 * distance)
    hard, soft = exact & (distance > 0.07), distance > 0.12
    return F.struct(F.when(hard, F.least(score, F.lit(0.25))).when(soft, F.least(score, F.lit(0.45))).otherwise(score).alias("score"), F.when(hard, "hard").when(soft, "soft").alias("contradiction"))


def colour_distance(a: Column, b: Column) -> Column:
    gap = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(gap) / 441.67


def footwear_geometry(eyelets: Column, panels: Column, outsole: Column, sole: Column, heel: Column, cut_differs: Column, aspect: Column, logo: Column, tread_differs: Column) -> Column:
    """1 less the penalties; arguments are absolute differences."""
    gone = (
        F.least(F.lit(0.35), 0.12 * eyelets)
        + F.least(F.lit(0.3), 0.14 * panels)
        + F.when(outsole > 0.04, F.least(F.lit(0.2), outsole)).otherwise(0.0)
        + F.when(sole > 0.08, 0.08).otherwise(0.0)
        + F.when((heel > 0.15) | cut_differs, 0.12).otherwise(0.0)
        + F.when(aspect > 0.25, 0.08).otherwise(0.0)
        + F.when(logo > 0.18, F.least(F.lit(0.16), logo)).otherwise(0.0)
        + F.when(tread_differs, 0.1).otherwise(0.0)
    )
    return clamp(1 - gone)


def plain_geometry(aspect: Column) -> Column:
    return clamp(1 - F.least(F.lit(1.0), aspect) - F.when(aspect > 0.25, 0.08).otherwise(0.0))


def with_correspondence(geometry: Column, inliers: Column, ratio: Column) -> Column:
    return F.when(inliers >= 10, F.greatest(geometry, F.lit(0.92))).when(ratio > 0.4, clamp(geometry + 0.04)).otherwise(geometry)


def part_score(strong: Column, confidence: Column) -> Column:
    return F.when(strong, F.lit(0.95)).otherwise(F.greatest(F.lit(0.35), F.least(F.lit(0.55), confidence)))


#: Weights of the parts of item match.
ITEM = {"text": 0.18, "visual": 0.18, "parts": 0.30, "geometry": 0.16, "material": 0.08, "cross": 0.10}


def item_match(text: Column, visual: Column, parts: Column, geometry: Column, material: Column, cross: Column, hard: Column, missing: Column, cited: Column) -> Column:
    """From intervals (parts: a plain mean). The lower bound weighs the parts' lower bounds and lifts on strong identity.

    Hard contradictions cap the interval instead.
    """
    whole = {"text": text, "visual": visual, "geometry": geometry, "material": material, "cross": cross}
    weigh = lambda bound, own: sum((ITEM[k] * v[bound] for k, v in whole.items()), ITEM["parts"] * own)
    mean = clamp(weigh("mean", parts))
    spread = 0.04 + 0.03 * F.least(F.lit(4), missing)
    lower = F.least(mean, clamp(F.least(mean, weigh("lower_bound", F.greatest(F.lit(0.0), parts - 0.06))) - 0.15 * spread))
    upper = F.greatest(mean, clamp(F.greatest(mean, F.lit(0.55)) + 0.04))
    strong = (parts >= 0.9) & (geometry["mean"] >= 0.9) & ((visual["mean"] >= 0.88) | cited) & (missing <= 2) & (hard == 0)
    lower = F.when(strong, F.least(mean, F.greatest(lower, F.lit(0.91)))).otherwise(lower)
    return hard_penalty(interval(mean, lower, upper), hard)


#: Weights of the parts of authenticity.
AUTHENTICITY = {"construction": 0.24, "label": 0.16, "logo": 0.12, "material": 0.12, "photo": 0.12, "originality": 0.08, "source": 0.08, "provenance": 0.08}


def authenticity_mean(parts: dict[str, Column], hard: Column, completeness: Column, price_pull: Column) -> Column:
    """Weighted over the parts that are established (not null); price only pulls down."""
    base = F.coalesce(weighted_mean([(AUTHENTICITY[k], v) for k, v in parts.items()]), F.lit(0.5))
    base = F.when((hard == 0) & (completeness >= 0.65), F.least(F.lit(1.0), base + 0.12)).otherwise(base)
    base = clamp(base - F.greatest(F.lit(0.0), price_pull))
    return F.when(hard > 0, F.least(base, F.lit(0.22))).otherwise(base)


def public_label(calibrated: Column, hard: Column, completeness: Column, lower: Column) -> Column:
    return (
        F.when(~calibrated, "INCOMPLETE").when(hard > 0, "CONTRADICTORY").when(completeness < 0.5, "INCOMPLETE")
        .when(lower >= 0.80, "HIGH").when(lower >= 0.50, "MODERATE").otherwise("INCOMPLETE")
    )


def view_completeness(expected: Column, critical: Column, present: Column) -> Column:
    def part(views: Column) -> Column:
        return F.when(F.size(views) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(views, present)) / F.size(views))

    return F.bround(0.6 * part(expected) + 0.4 * part(critical), 4)


def image_completeness(images: Column, evidence_missing: Column) -> Column:
    start = F.when(images > 0, F.lit(0.4)).otherwise(0.15)
    return F.when(evidence_missing, F.least(start, F.lit(0.35))).otherwise(F.greatest(start, F.lit(0.2))) + 0.15 * F.least(F.lit(3), images)


def utility(live: Column, size_match: Column, region_match: Column, images: Column, described: Column, verified: Column) -> Column:
    """A size or region match of 0 counts as unknown, like null."""
    half = F.lit(0.5)
    coverage = F.least(F.lit(1.0), images / 4)
    return 0.45 * live.cast("double") + 0.15 * F.coalesce(F.nullif(size_match, F.lit(0.0)), half) + 0.1 * F.coalesce(F.nullif(region_match, F.lit(0.0)), half) + 0.1 * coverage + 0.1 * F.when(described, 0.6).otherwise(0.25) + 0.1 * verified.cast("double")


def real_gate(item_lower: Column, auth_lower: Column, completeness: Column, live: Column, verified: Column, hard: Column, scam: Column, vetoes: Column) -> Column:
    return (item_lower >= 0.90) & (auth_lower >= 0.80) & (completeness >= 0.65) & live & verified & (hard == 0) & ~scam & (F.size(vetoes) == 0)


def possibly_gate(item_lower: Column, hard_item: Column, hard_auth: Column, scam: Column, vetoes: Column) -> Column:
    return (item_lower >= 0.45) & (hard_item == 0) & (hard_auth == 0) & ~scam & (F.size(vetoes) == 0)


def hard_vetoes(conditions: list[tuple[str, Column]]) -> Column:
    """Codes whose condition holds, in the order given, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, code) for code, c in conditions))))


def bucket(real: Column, possibly: Column, replica: Column, usable_link: Column) -> Column:
    return F.when(~usable_link, "HIDDEN").when(replica, "REPLICA").when(real, "REAL").when(possibly, "POSSIBLY_REAL").otherwise("HIDDEN")


def screened(auth_lower: Column, ran: Column, gate: float = 0.80) -> Column:
    """Without photo screening authenticity stays just below the gate."""
    return F.when(ran, auth_lower).otherwise(F.least(auth_lower, F.lit(gate - 0.01)))


def information_gain(posterior: Column, novelty: Column, overlap: Column, sources: Column, cost: Column) -> Column:
    return F.bround(posterior * novelty * (1 - overlap) * (0.4 + F.least(F.lit(1.0), 0.25 * sources)) / (1 + cost), 4)


def frontier_priority(match: Column, gap: Column, discrimination: Column, novelty: Column, liveness: Column, fetch: Column, duplication: Column, block: Column, risk: Column) -> Column:
    return match + gap + discrimination + novelty + liveness - fetch - duplication - block - risk


def backoff_seconds(attempt: Column, asked: Column) -> Column:
    """Doubling from one second to thirty; what the server asks for counts up to sixty."""
    own = F.least(F.lit(30.0), F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))
    return F.when(asked.isNull(), own).otherwise(F.least(F.lit(60.0), F.greatest(F.lit(0.0), asked)))


def present_availability(stored: Column, checked: Column, now: Column, ttl: int = 6 * 3600) -> Column:
    return F.when(checked.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(checked) > ttl), "UNKNOWN").otherwise(stored)


def cheap_visual(own_hash: Column, other_hash: Column, own_colours: Column, other_colours: Column) -> Column:
    """Similarity of two photographs by hash and colour alone."""
    return 0.6 * F.greatest(F.lit(0.0), hash_similarity(own_hash, other_hash)) + 0.4 * histogram_similarity(own_colours, other_colours)


def scorer(embedding: Column, cheap: Column) -> Column:
    """Which of two similarities counts and its name: the embedding's where there is one."""
    return F.when(embedding.isNotNull(), F.struct(embedding.alias("score"), F.lit("embedding").alias("scorer"))).otherwise(F.struct(cheap.alias("score"), F.lit("cheap").alias("scorer")))


def image_quality(resolution: Column, sharpness: Column, compression: Column, occlusion: Column, lighting: Column, subject: Column, background: Column, text: Column, parts: Column, unique: Column) -> Column:
    base = 0.20 * resolution + 0.15 * sharpness + 0.10 * compression + 0.10 * (1 - occlusion) + 0.10 * lighting + 0.15 * subject + 0.10 * background + 0.05 * text + 0.05 * parts
    return clamp(base + F.when(unique, 0.12).otherwise(0.0))
