"""Sub-scores of authenticity as columns: what a part's mean, spread, contradictions and gaps are.

Reference and candidate are structs of what was measured on their photographs, null without one: eyelet_count,
panel_count, outsole_ratio, heel_cut, label_hash, logo_x, logo_y, logo_kind, rgb, smoothness.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import scores as S

# fixed values: heels whose shapes can be told apart, payments outside a platform, words for papers and packaging
HEELS = ["block", "rounded", "notched"]
OUTSIDE = ["off-platform", "wire", "crypto-only"]
PAPERS = ["receipt", "box", "dust bag", "dustbag", "invoice"]
PRODUCT_CODE = r"^[A-Z0-9][A-Z0-9\-]{3,}$"


def codes(*conditions: tuple[Column, str]) -> Column:
    """Names whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, name) for c, name in conditions))).cast("array<string>")


def assessed(mean: Column | float, spread: Column | float, hard: Column | None = None, missing: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    one = lambda x: F.lit(x) if isinstance(x, float) else x
    return F.struct(one(mean).alias("mean"), one(spread).alias("spread"), (none if hard is None else hard).alias("hard"), (none if missing is None else missing).alias("missing"))


def _missing(mean: float, spread: float, what: str) -> Column:
    return assessed(mean, spread, missing=F.array(F.lit(what)))


def interval_of(part: Column) -> Column:
    return S.spread_interval(part["mean"], part["spread"])


def logo_distance(a: Column, b: Column, mirror: bool = True) -> Column:
    """Distance of two places on a unit square, mirrored left to right where that is less; 1 without one of them."""
    rise = (a["logo_y"] - b["logo_y"]) * (a["logo_y"] - b["logo_y"])
    straight, turned = a["logo_x"] - b["logo_x"], 1.0 - a["logo_x"] - b["logo_x"]
    found = F.sqrt(straight * straight + rise)
    found = F.least(found, F.sqrt(turned * turned + rise)) if mirror else found
    return F.coalesce(F.least(F.lit(1.0), found), F.lit(1.0))


def heels_differ(a: Column, b: Column) -> Column:
    return F.coalesce((a["heel_cut"] != b["heel_cut"]) & a["heel_cut"].isin(HEELS) & b["heel_cut"].isin(HEELS), F.lit(False))


def construction(checks: Column, ref: Column, cand: Column) -> Column:
    """Penalties for what the category's `checks` (array of names) can measure; without checks nothing is established."""
    on = lambda name: F.array_contains(checks, name)
    gap = lambda field: F.abs(ref[field] - cand[field])
    found = [
        (on("eyelet_count") & (gap("eyelet_count") >= 2), "construction-eyelet-count", 0.35), (on("panel_count") & (gap("panel_count") >= 1), "construction-panel-count", 0.3),
        (on("outsole_geometry") & (gap("outsole_ratio") >= 0.07), "construction-outsole", 0.2), (on("heel_construction") & heels_differ(ref, cand), "construction-heel", 0.2),
    ]
    hard = codes(*((c, name) for c, name, _ in found))
    penalty = sum((F.when(c, p).otherwise(0.0) for c, _, p in found), F.lit(0.0))
    measured = assessed(F.greatest(F.lit(0.08), 0.9 - penalty), F.when(F.size(hard) > 0, 0.16).otherwise(0.07), hard)
    return F.when(F.coalesce(F.size(checks), F.lit(0)) == 0, _missing(0.5, 0.25, "construction-unestablished")).when(ref.isNull() | cand.isNull(), _missing(0.45, 0.25, "construction-view")).otherwise(measured)


def labels(ref: Column, cand: Column, code: Column) -> Column:
    """Equal label hashes speak for an item; other hashes say nothing, as two photographs of one label differ."""
    seen = lambda x: F.coalesce(x["label_hash"] != "", F.lit(False))
    odd = codes((F.coalesce((code != "") & ~code.rlike(PRODUCT_CODE), F.lit(False)), "code-format-uncertain"))
    return F.when(~seen(cand), _missing(0.42, 0.22, "label-view")).when(~seen(ref), _missing(0.48, 0.2, "reference-label")).when(ref["label_hash"] != cand["label_hash"], _missing(0.45, 0.18, "label-code-unresolved")).otherwise(assessed(0.82, 0.08, missing=odd))


def logos(ref: Column, cand: Column) -> Column:
    other = F.coalesce((ref["logo_kind"] != "") & (cand["logo_kind"] != "") & (ref["logo_kind"] != cand["logo_kind"]), F.lit(False))
    placed = lambda x: x["logo_x"].isNotNull() & x["logo_y"].isNotNull()
    return F.when(ref.isNull() | cand.isNull(), _missing(0.45, 0.2, "logo-view")).when(~(placed(ref) & placed(cand)), _missing(0.48, 0.18, "logo-not-resolved")).when((logo_distance(ref, cand) >= 0.18) | other, assessed(0.2, 0.12, F.array(F.lit("logo-incompatible")))).otherwise(assessed(0.84, 0.08))


def materials(ref: Column, cand: Column, exact: Column) -> Column:
    """Colour and, weakly, smoothness; a colour demanded exactly contradicts beyond 0.07."""
    far = S.colour_distance(ref["rgb"], cand["rgb"])
    mean = F.greatest(F.lit(0.15), 0.85 - 2.8 * far - 0.3 * F.abs(ref["smoothness"] - cand["smoothness"]))
    wrong = exact & (far > 0.07)
    return F.when(ref.isNull() | cand.isNull(), _missing(0.45, 0.22, "material-view")).otherwise(assessed(F.when(wrong, F.least(mean, F.lit(0.25))).otherwise(mean), 0.12, codes((wrong, "material-colourway"))))


def photo_set(consistency: Column, contradictions: Column, stock: Column) -> Column:
    """From a gallery's consistency and contradictions (`matching.gallery_consistency`); a stock photograph put in caps the score."""
    return assessed(F.when(stock, F.least(consistency, F.lit(0.4))).otherwise(consistency), 0.1, F.filter(contradictions, lambda c: c.contains("incompatible")))


def originality(stolen: Column, stock: Column) -> Column:
    return F.when(stolen | stock, assessed(0.12, 0.1, F.array(F.lit("image-theft-or-rehost")))).otherwise(assessed(0.7, 0.1))


def source(replica: Column, malicious: Column, account_days: Column, payment: Column) -> Column:
    """Young accounts and payment elsewhere count against a listing; what it says of itself decides. Badges never do."""
    hard = codes((replica, "self-declared-replica"), (malicious, "malicious-url"))
    mean = 0.55 - F.when(account_days < 7, 0.08).otherwise(0.0) - F.when(F.lower(payment).isin(OUTSIDE), 0.08).otherwise(0.0)
    return assessed(F.when(F.size(hard) > 0, 0.12).otherwise(mean), 0.14, hard)


def provenance(text: Column) -> Column:
    """Papers and packaging mentioned; weak, and never above 0.62."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((low.contains(w).cast("int") for w in PAPERS), F.lit(0))
    return F.when(hits == 0, _missing(0.4, 0.2, "provenance")).otherwise(assessed(F.least(F.lit(0.62), 0.4 + 0.08 * hits), 0.16))


def geometry(ref: Column, cand: Column, footwear: Column) -> Column:
    """Score from differences of structure (also sole_to_upper, heel_angle, aspect, tread_kind); other goods by aspect alone."""
    gap = lambda field: F.abs(ref[field] - cand[field])
    tread = (ref["tread_kind"] != cand["tread_kind"]) & (ref["tread_kind"] != "unknown") & (cand["tread_kind"] != "unknown")
    shoe = S.footwear_geometry(gap("eyelet_count"), gap("panel_count"), gap("outsole_ratio"), gap("sole_to_upper"), gap("heel_angle"), heels_differ(ref, cand), gap("aspect"), logo_distance(ref, cand), tread)
    return F.when(footwear, shoe).otherwise(S.plain_geometry(gap("aspect")))


def contradictions(ref: Column, cand: Column, footwear: Column, exact: Column, colour_hard: Column, label_mismatch: Column) -> Column:
    """Struct of hard and soft contradictions of an item, in a fixed order."""
    gap = lambda field: F.abs(ref[field] - cand[field])
    eyelets, outsole = gap("eyelet_count"), gap("outsole_ratio")
    differ = ref["heel_cut"] != cand["heel_cut"]
    heel = (gap("heel_angle") >= 0.25) | heels_differ(ref, cand)
    kinds = F.coalesce((ref["logo_kind"] != "") & (cand["logo_kind"] != "") & (ref["logo_kind"] != cand["logo_kind"]), F.lit(False))
    placed = ref["logo_x"].isNotNull() & cand["logo_x"].isNotNull() & (logo_distance(ref, cand) >= 0.18)
    hard = codes(
        (footwear & (eyelets >= 2), "eyelet-count-mismatch"), (footwear & (gap("panel_count") >= 1), "panel-count-mismatch"), (footwear & (outsole >= 0.07), "outsole-geometry-mismatch"), (footwear & heel & differ, "heel-construction-mismatch"),
        (footwear & placed, "logo-placement-mismatch"), (footwear & label_mismatch, "label-code-mismatch"), (exact & colour_hard, "colourway-hard-mismatch"),
    )
    soft = codes((footwear & (eyelets == 1), "eyelet-count-soft"), (footwear & (outsole >= 0.04) & (outsole < 0.07), "outsole-geometry-soft"), (footwear & heel & ~differ, "heel-angle-soft"), (footwear & kinds, "logo-kind-soft"))
    return F.struct(hard.alias("hard"), soft.alias("soft"))


# fixed values: which profile a category is judged by; others are generic
PROFILES = {"footwear": "footwear", "designer_footwear": "footwear", "sneaker": "footwear", "trainer": "footwear", "shoe": "footwear", "garment": "garment", "designer_garment": "garment", "clothing": "garment", "outerwear": "garment", "top": "garment", "bottom": "garment", "shirt": "garment", "shirts": "garment", "long-sleeve": "garment", "longsleeve": "garment", "long_sleeve": "garment", "cutsew": "garment"}


def profile_of(category: Column) -> Column:
    """Name of a category's profile, generic:<category> for those without one, generic:unknown for none."""
    key = F.regexp_replace(F.lower(F.trim(category)), "^generic:", "")
    table = F.create_map(*(F.lit(x) for kv in PROFILES.items() for x in kv))
    return F.when(F.coalesce(category, F.lit("")) == "", "generic:unknown").otherwise(F.coalesce(F.try_element_at(table, key), F.concat(F.lit("generic:"), key)))
