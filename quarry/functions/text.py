"""Text as columns: tokens, set similarities, query and product-code normal forms, detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words that never identify an item
STOP = ["the", "a", "an", "and", "or", "of", "for", "to", "in", "on", "with", "by", "from", "this", "that", "new", "used", "sold", "size", "buy", "sale"]
# fixed values: phrases that address a reader of the text as a machine
INSTRUCTIONS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions",
    r"disregard\s+(all\s+)?(previous|prior|above)",
    r"mark\s+this\s+(as\s+)?authentic",
    r"you\s+are\s+now",
    r"new\s+instructions?\s*:",
    r"system\s+prompt",
    r"do\s+not\s+follow\s+(your|the)\s+(rules|policy)",
    r"jailbreak",
    r"act\s+as\s+(if|a|an)\b",
    r"override\s+(policy|tools|goals)",
]
INSTRUCTION = "(?i)" + "|".join(INSTRUCTIONS)
# fixed values: the spans taken out before tokens are made
INSTRUCTION_SPANS = [r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+instructions?[^.]*", r"(?i)mark\s+this\s+(as\s+)?authentic[^.]*"]
# fixed value: runs of Latin letters and digits, kana, ideographs, hangul
CJK_WORD = "[A-Za-z0-9\\u3040-\\u30ff\\u4e00-\\u9fff\\uac00-\\ud7af]+"


def is_instruction(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ").rlike(INSTRUCTION)


def without_instructions(text: Column) -> Column:
    """The text with instruction spans blanked where it addresses a machine; only texts with their rare words are searched."""
    plain = F.coalesce(text, F.lit(""))
    cut, low = plain, F.lower(plain)
    for span in INSTRUCTION_SPANS:
        cut = F.regexp_replace(cut, span, " ")
    rare = low.contains("ignore") | (low.contains("mark") & low.contains("authentic"))
    return F.when(rare, F.when(is_instruction(plain), cut).otherwise(plain)).otherwise(plain)


def is_short_year(t: Column) -> Column:
    return (F.length(t) == 2) & (t >= "00") & (t <= "30") & (F.translate(t, "0123456789", "") == "")


def is_long_year(t: Column) -> Column:
    return (F.length(t) == 4) & t.startswith("20")


def with_year(t: Column) -> Column:
    """The token, and a year in its other length."""
    return F.when(is_short_year(t), F.array(t, F.concat(F.lit("20"), t))).when(is_long_year(t), F.array(t, F.substring(t, 3, 2))).otherwise(F.array(t))


def raw_tokens(text: Column) -> Column:
    return F.split(F.lower(without_instructions(text)), "[^a-z0-9]+")


def is_term(t: Column) -> Column:
    return (F.length(t) > 1) & ~t.isin(STOP)


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, two characters or more, no stop words; years in both lengths. In text order."""
    return F.flatten(F.transform(F.filter(raw_tokens(text), is_term), with_year))


def token_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and term, a row for each of `tokens`: taken apart first, so that words are tested in generated code."""
    rows = df.select(*keys, F.explode(raw_tokens(F.col(text))).alias("t")).where(is_term(F.col("t")))
    return rows.select(*keys, F.explode(with_year(F.col("t"))).alias("term"))


def title_tokens(text: Column) -> Column:
    """Distinct lower-cased words, with kana, ideographs and hangul."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CJK_WORD), F.lit(0)), F.lower))


def jaccard(a: Column, b: Column, when_empty: float = 0.0) -> Column:
    """Shared part of two sets; `when_empty` if both are empty, 0 if one is."""
    both, none = F.size(F.array_intersect(a, b)), (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(none, F.lit(when_empty)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def query_jaccard(a: Column, b: Column) -> Column:
    """Of two query texts, by words split at white space; two empty ones are equal."""
    return jaccard(words_of(a), words_of(b), when_empty=1.0)


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_query(text), " "), lambda w: w != ""))


def containment(a: Column, b: Column) -> Column:
    """Shared part of the smaller set."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def text_identity(query: Column, listing: Column) -> Column:
    return clamp(0.55 * jaccard(F.array_distinct(query), F.array_distinct(listing)) + 0.45 * containment(query, listing))


def near_duplicate(a: Column, b: Column, threshold: float = 0.85) -> Column:
    return jaccard(title_tokens(a), title_tokens(b)) >= threshold


def normal_query(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\"'`]+", ""), r"\s+", " ")))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def despaced(text: Column) -> Column:
    """Letters and digits only, digits read as the letters they stand for."""
    return F.translate(F.regexp_replace(F.lower(text), "[^0-9a-z]+", ""), "013457", "oleast")


def normal_code(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, r"[\s\-._/]+", ""))


# fixed value: what is a size and no product code
SIZE_CODE = r"(?i)^(?:eu\s*([3-5][0-9](?:\.[0-9])?)|us\s*([4-9]|1[0-6])(?:\.[0-9])?|uk\s*([3-9]|1[0-5])(?:\.[0-9])?|([3-5][0-9](?:\.[0-9])?)|(2[2-9](?:\.[0-9])?|3[0-2](?:\.[0-9])?)\s*cm|(2[2-9][0-9]|3[0-9]{2})\s*mm)$"


def is_size_code(code: Column) -> Column:
    compact = F.regexp_replace(F.lower(F.trim(code)), r"\s+", " ")
    return F.replace(compact, F.lit(" "), F.lit("")).rlike(SIZE_CODE) | compact.rlike(SIZE_CODE)


def code_verdict(code: Column, in_region: Column, structured: Column, consistent: Column) -> Column:
    """Why a product code is not taken, or ok: sizes stay sizes, and a code needs a place it was read at or a structured source."""
    plain = normal_code(code)
    return (
        F.when(plain == "", "empty").when(is_size_code(code) | is_size_code(plain), "size_code").when(~(in_region | structured), "needs_region_or_structured_source")
        .when(~consistent & ~in_region, "inconsistent").when(F.length(plain) < 4, "too_short").otherwise("ok")
    )


# fixed values: words of a catalogue query that say nothing, and what others are sold as
CATALOGUE_STOP = ["a", "an", "and", "brand", "des", "for", "in", "item", "no", "of", "on", "or", "s", "ss", "such", "the", "to", "type", "with", "x", "yes"]
SYNONYMS = {
    "pump": ["pump", "pumps", "パンプス", "ハイヒール"], "pumps": ["pump", "pumps", "パンプス", "ハイヒール"], "tee": ["tee", "tees", "tshirt", "tシャツ", "カットソー"], "tshirt": ["tee", "tees", "tshirt", "tシャツ", "カットソー"],
    "shirt": ["shirt", "shirts", "シャツ"], "shirts": ["shirt", "shirts", "シャツ"],
}


def catalogue_terms(folded: Column) -> Column:
    """Distinct words of a folded query with what they are also sold as, in order."""
    words = F.filter(F.split(F.translate(folded, "×✕/", "   "), r"(?U)[^\w]+"), lambda w: (F.length(w) > 1) & ~w.isin(CATALOGUE_STOP))
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*(F.lit(w) for w in v)))))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array(w)))))


# fixed values of the token classes
COUNTRIES = ["italy", "france", "spain", "portugal", "china"]
OVERLAYS = ["sold", "like", "likes", "save"]
NOT_BRAND = ["size", "the", "and", "for", "new", "sold", "from", "with", "this", "that", "italy", "france", "spain", "china"]


def token_class(text: Column, materials: list[str], colours: list[str], sizes: list[str]) -> Column:
    """First class that fits, in the order given here."""
    raw = F.trim(text)
    low = F.lower(raw)
    return (
        F.when(is_instruction(raw), "instruction")
        .when(raw.rlike(r"^@[\w.]{2,}$"), "handle")
        .when(low.rlike(r"^[$€£¥₩]\s?[0-9]|[0-9]+\s?(usd|eur|gbp|jpy|krw)$") | low.isin(OVERLAYS), "overlay")
        .when(low.rlike(r"^(made\s+in|fabriqu[eé]\s+en|hergestellt\s+in)\b") | low.isin(COUNTRIES), "country")
        .when(low.isin(materials), "material")
        .when(low.isin(colours), "colour")
        .when(low.rlike(r"^(?:ss|aw|fw|resort|pre-?fall|cruise)\s*'?[0-9]{2}$"), "season")
        .when(raw.rlike("^(?:19|20)[0-9]{2}$"), "season")
        .when(low.isin(sizes) | F.replace(low, F.lit(" "), F.lit("")).rlike(r"^(?:eu|us|uk|it|fr)[0-9]{1,2}(?:\.5)?$"), "size")
        .when(raw.rlike(r"^[A-Z0-9][A-Z0-9\-]{4,}$") & raw.rlike("[0-9]") & raw.rlike("[A-Za-z]"), "product_code")
        .when(raw.rlike("^[A-Z]{4,16}$") & ~low.isin(NOT_BRAND), "brand")
        .otherwise("unknown")
    )


def match_score(queries: list[list[str]], haystack: Column) -> Column:
    """Largest number of a query's terms found: plain terms as tokens, others as substrings."""
    have, low = tokens(haystack), F.lower(F.coalesce(haystack, F.lit("")))

    def hits(terms: list[str]) -> Column:
        parts = [(F.array_contains(have, t) if t.isascii() else low.contains(t)).cast("int") for t in terms]
        return sum(parts, F.lit(0))

    scores = [hits(q) for q in queries]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]
