"""Matching over descriptor columns: cheap signals, view pairs, contradictions, parts, references, sub-scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators.cluster import components


def cheap_signals(rows: DataFrame) -> DataFrame:
    """recall from columns of one candidate beside its hypothesis.

    query_terms, listing_terms, ocr_terms (arrays), ref_hash, phash, ref_histogram, histogram, ref_mask, mask,
    category, listed_category, brand, embedding (similarity or null).
    """
    perceptual = F.when(F.col("phash").isNull() | F.col("ref_hash").isNull(), F.lit(0.0)).otherwise(V.hash_similarity(F.col("ref_hash"), F.col("phash")))
    colour = F.coalesce(V.histogram_similarity(F.col("ref_histogram"), F.col("histogram")), F.lit(0.0))
    rows = rows.withColumn("_p", perceptual)
    recall = S.recall_score(
        T.text_identity(F.col("query_terms"), F.col("listing_terms")), T.text_identity(F.col("query_terms"), F.col("ocr_terms")), F.col("_p"), colour, S.silhouette_signal(F.col("ref_mask"), F.col("mask"), F.col("_p")),
        S.category_signal(F.col("category"), F.col("listed_category")), S.brand_signal(F.col("brand"), F.col("listing_terms")), F.col("embedding"),
    )
    return rows.withColumn("recall", recall).drop("_p")


#: Views in the order in which pairs are tried: both sides first, then the ends, then details.
VIEW_ORDER = ["lateral", "medial", "front", "back", "top", "sole", "label", "detail"]


def view_pairs(references: DataFrame, candidates: DataFrame, budget: int = 9) -> DataFrame:
    """Pairs of a candidate's views with the reference views of its own search, equal views first, at most `budget` a candidate.

    references(search_id, reference_id, ref_view, ...) are the few photographs of a search; candidates(search_id,
    candidate_id, image_id, view, ...).
    """
    order = F.array(*(F.lit(v) for v in VIEW_ORDER))
    at = lambda c: F.when(F.array_position(order, F.col(c)) == 0, 99).otherwise(F.array_position(order, F.col(c)))
    met = candidates.join(references, "search_id")
    w = Window.partitionBy("search_id", "candidate_id").orderBy(F.when(F.col("view") == F.col("ref_view"), 0).otherwise(1), at("ref_view"), at("view"), "reference_id", "image_id")
    return met.withColumn("pair", F.row_number().over(w)).where(F.col("pair") <= budget)


def colour_across(pairs: DataFrame, exact: Column) -> DataFrame:
    """candidate_id, colour, contradiction: a hard contradiction of any pair wins, else the best pair."""
    rows = pairs.withColumn("_c", S.colour_consistency(F.col("colour_distance"), exact))
    hard = F.col("_c.contradiction") == "hard"
    sums = rows.groupBy("candidate_id").agg(F.min(F.when(hard, F.col("_c.score"))).alias("_hard"), F.max_by("_c", "_c.score").alias("_best"))
    return sums.select("candidate_id", F.coalesce("_hard", "_best.score").alias("colour"), F.when(F.col("_hard").isNotNull(), "hard").otherwise(F.col("_best.contradiction")).alias("contradiction"))


def construction_across(pairs: DataFrame) -> DataFrame:
    """candidate_id, geometry, reference_id, image_id: the worst geometry, with the mirrored reading where it fits better."""
    rows = pairs.withColumn("_g", F.greatest("geometry", F.coalesce("mirrored", F.lit(0.0))))
    worst = rows.groupBy("candidate_id").agg(F.min("_g").alias("geometry"), F.min_by(F.struct("reference_id", "image_id"), F.struct("_g", "reference_id", "image_id")).alias("p"))
    return worst.select("candidate_id", "geometry", "p.*")


def stock_photo_gap(descriptors: DataFrame, spread: float = 0.45) -> DataFrame:
    """candidate_id, gap: whether photographs of one view differ more in smoothness than one camera would make them; graphics do not count."""
    each = descriptors.where(F.col("view").cast("string") != "graphic").groupBy("candidate_id", "view").agg((F.max("smoothness") - F.min("smoothness")).alias("d"))
    flagged = each.groupBy("candidate_id").agg(F.bool_or(F.col("d") > spread).alias("gap"))
    return descriptors.select("candidate_id").distinct().join(flagged, "candidate_id", "left").select("candidate_id", F.coalesce("gap", F.lit(False)).alias("gap"))


def gallery_consistency(descriptors: DataFrame, footwear: bool = True) -> DataFrame:
    """candidate_id, colour_spread, score, contradictions: how well the photographs of one listing agree.

    descriptors(candidate_id, view, eyelet_count, panel_count, label_hash, rgb, smoothness). Colours of side views, or of
    all but labels if there are none, are compared pair by pair; equal colours are one, and a gallery is short.
    """
    side = F.col("eyelet_count") >= 3
    shape = (F.col("eyelet_count") >= 2) & (F.col("panel_count") >= 2)
    apart = lambda c: F.max(F.when(shape, F.col(c))) - F.min(F.when(shape, F.col(c)))
    sums = descriptors.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(side).alias("sides"), F.count_if(F.col("label_hash").isNull()).alias("plain"), F.collect_set(F.when(side, F.col("rgb"))).alias("side_colours"), F.collect_set(F.when(F.col("label_hash").isNull(), F.col("rgb"))).alias("plain_colours"),
        F.count_if(shape).alias("shapes"), apart("eyelet_count").alias("eyelets"), apart("panel_count").alias("panels"),
    ).join(stock_photo_gap(descriptors), "candidate_id")
    colours, shown = F.when(F.col("sides") > 0, F.col("side_colours")).otherwise(F.col("plain_colours")), F.when(F.col("sides") > 0, F.col("sides")).otherwise(F.col("plain"))
    rows = sums.withColumn("g", colours).withColumn("colour_spread", F.coalesce(F.array_max(F.flatten(F.transform("g", lambda a: F.transform("g", lambda b: S.colour_distance(a, b))))), F.lit(0.0)))
    eyelets, panels = (F.lit(footwear) & (F.col("shapes") >= 2) & (F.col(c) >= 2) for c in ("eyelets", "panels"))
    base = F.when(shown < 2, F.lit(0.78)).otherwise(F.greatest(F.lit(0.2), 1 - 2.4 * F.col("colour_spread")))
    capped = F.least(base, F.when(eyelets | panels, 0.25), F.when(F.col("gap"), 0.4))
    single = F.col("n") < 2
    found = F.array_compact(F.array(F.when(eyelets, "gallery-eyelet-incompatible"), F.when(panels, "gallery-panel-incompatible"), F.when(F.col("gap"), "stock-photo-smoothness-gap")))
    return rows.select("candidate_id", "colour_spread", F.when(single, 0.55).otherwise(capped).alias("score"), F.when(single, F.array().cast("array<string>")).otherwise(found).alias("contradictions"))


def compare_parts(spec: DataFrame, parts: DataFrame) -> DataFrame:
    """candidate_id, parts_mean, critical_missing from the category's parts and what a candidate shows; 0.4 without any."""
    want = spec.select("category", "part", "critical")
    have = parts.select("candidate_id", "category", "part", S.part_score(F.col("strong"), F.col("confidence")).alias("score"))
    each = have.select("candidate_id", "category").distinct().join(want, "category").join(have, ["candidate_id", "category", "part"], "left")
    return each.groupBy("candidate_id").agg(F.coalesce(F.avg("score"), F.lit(0.4)).alias("parts_mean"), F.count_if(F.col("critical") & F.col("score").isNull()).alias("critical_missing"))


def unify_references(images: DataFrame, distance: int = 12, colour: float = 0.18) -> DataFrame:
    """images(search_id, image_id, hash, histogram) to search_id, image_id, cluster, size, confidence, place: near in hash and in colour.

    Only photographs of one search meet, a handful each; image ids differ between searches. Equal photographs are one
    before they meet, so that a search with a photograph repeated without end costs no pairs for it.
    """
    heads = images.groupBy("search_id", "hash", "histogram").agg(F.min("image_id").alias("head"))
    a, b = (heads.select("search_id", F.col("head").alias(x), F.col("hash").alias(f"hash_{x}"), F.col("histogram").alias(f"colour_{x}")) for x in "ab")
    near = (V.hex_distance(F.col("hash_a"), F.col("hash_b")) <= distance) & (1 - V.histogram_similarity(F.col("colour_a"), F.col("colour_b")) < colour)
    linked = components(a.join(b, "search_id").where(F.col("a") < F.col("b")).where(near).select("a", "b"))
    named = heads.join(linked.withColumnRenamed("node", "head"), "head", "left").withColumn("cluster", F.coalesce("component", "head"))
    rows = images.join(named.select("search_id", "hash", "histogram", "cluster"), ["search_id", "hash", "histogram"]).select("search_id", "image_id", "cluster")
    size = rows.groupBy("search_id", "cluster").agg(F.count(F.lit(1)).alias("size"))
    placed = size.withColumn("place", F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("size"), "cluster")))
    return rows.join(placed, ["search_id", "cluster"]).select("search_id", "image_id", "cluster", "size", F.least(F.lit(0.9), 0.4 + 0.15 * F.col("size")).alias("confidence"), "place")


def hypothesis_kinds(hypotheses: DataFrame) -> DataFrame:
    """search_id, brand, model, category, members: hypotheses of a search that say the same are one kind."""
    return hypotheses.groupBy("search_id", "brand", "model", "category").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("members"))


def hypothesis_graph(hypotheses: DataFrame) -> DataFrame:
    """Edges a <= b between kinds of hypotheses of a search (by their smallest ids) and how many pairs of hypotheses each stands for.

    same_item, same_brand, or competes (other brand, same category); unrelated kinds have none. Kinds meet on brand or
    category only, and a kind with itself counts its own pairs, so equal hypotheses cost no pairs.
    """
    kinds = hypothesis_kinds(hypotheses)
    own = kinds.where(F.col("members") > 1).select("search_id", F.col("head").alias("a"), F.col("head").alias("b"), F.lit("same_item").alias("kind"), (F.col("members") * (F.col("members") - 1) / 2).cast("long").alias("pairs"))
    a, b = (kinds.select("search_id", *(F.col(c).alias(f"{x}_{c}") for c in ("head", "brand", "model", "category", "members"))) for x in "ab")
    brand = a.join(b, (a["search_id"] == b["search_id"]) & (F.col("a_brand") == F.col("b_brand")) & (F.col("a_head") < F.col("b_head"))).select(a["search_id"], "a_head", "b_head", F.when(F.col("a_model") == F.col("b_model"), "same_item").otherwise("same_brand").alias("kind"), "a_members", "b_members")
    rival = a.join(b, (a["search_id"] == b["search_id"]) & (F.col("a_category") == F.col("b_category")) & (F.col("a_brand") != F.col("b_brand")) & (F.col("a_head") < F.col("b_head"))).select(a["search_id"], "a_head", "b_head", F.lit("competes").alias("kind"), "a_members", "b_members")
    met = brand.unionByName(rival)
    return own.unionByName(met.select("search_id", F.col("a_head").alias("a"), F.col("b_head").alias("b"), "kind", (F.col("a_members") * F.col("b_members")).alias("pairs")))


def established(items: Column, shown: Column) -> Column:
    """Claims that the category can show at all."""
    return F.filter(items, lambda i: F.array_contains(shown, i))


#: Spread of each part of item match, as an interval around its mean.
SPREADS = {"text": 0.05, "visual": 0.08, "geometry": 0.06, "material": 0.10, "cross": 0.08}


def advice(listing_text: Column, support: Column, contradictions: Column, missing: Column) -> Column:
    """Notes of a critic that never promotes: what the evidence holds, and that instructions in a listing are data."""
    return F.array_compact(F.array(
        F.lit("adjudicator=local_deterministic"), F.lit("output=advisory"), F.when(T.is_instruction(listing_text), "instruction-like listing text treated as data"),
        F.when(F.size(contradictions) > 0, "contradictions_present"), F.when(F.size(missing) > 0, "missing_evidence_present"), F.when(F.size(support) > 0, "support_cited"),
    ))


def match_evidence(rows: DataFrame) -> DataFrame:
    """The interval of candidates with component columns text, visual, parts, geometry, material, cross, similarity, inliers, ratio, hard, missing."""
    visual = S.blended_visual(F.col("visual"), F.col("similarity"))
    geometry = S.with_correspondence(F.col("geometry"), F.col("inliers"), F.col("ratio"))
    part = {"text": F.col("text"), "visual": visual, "geometry": geometry, "material": F.col("material"), "cross": F.col("cross")}
    iv = {k: S.spread_interval(v, F.lit(SPREADS[k])) for k, v in part.items()}
    return rows.withColumn("item_match", S.item_match(iv["text"], iv["visual"], F.col("parts"), iv["geometry"], iv["material"], iv["cross"], F.col("hard"), F.col("missing"), F.col("inliers") >= 10))
