"""Prices and sizes as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: symbols in order of precedence, then codes
SYMBOLS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("円", "JPY"), ("₩", "KRW"), ("₹", "INR")]
CODES = "USD|EUR|GBP|JPY|KRW|CNY|AUD|CAD|CHF|SEK|NOK|DKK|HKD|TWD|SGD"
WHOLE = ["JPY", "KRW", "CNY"]
# fixed value: what an amount looks like
AMOUNT = r"(?<!\w)(?:USD|EUR|GBP|JPY|KRW|CNY|\$|€|£|¥|₩)?\s*([0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{1,2})|[0-9]+(?:[.,][0-9]{1,2})?)"


def currency(text: Column, hint: Column | None = None) -> Column:
    found = [F.when(text.contains(s), code) for s, code in SYMBOLS]
    code = F.nullif(F.upper(F.regexp_extract(text, rf"(?i)\b({CODES})\b", 1)), F.lit(""))
    return F.coalesce(*([F.upper(F.nullif(hint, F.lit("")))] if hint is not None else []), *found, code)


def amount(text: Column, hint: Column | None = None) -> Column:
    """The price as decimal(18,4); in currencies without decimals all digits of the text count."""
    raw = F.nullif(F.regexp_extract(text, AMOUNT, 1), F.lit(""))
    whole = currency(text, hint).isin(WHOLE) | text.rlike("[¥円₩]")
    comma, dot = F.length(raw) - F.locate(",", F.reverse(raw)), F.length(raw) - F.locate(".", F.reverse(raw))
    both = raw.contains(",") & raw.contains(".")
    decimal_comma = raw.rlike("^[^,]*,[0-9]{1,2}$")
    tidy = (
        F.when(F.coalesce(whole, F.lit(False)), F.regexp_replace(text, "[^0-9]", ""))
        .when(both & (comma > dot), F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(raw, F.lit(","), F.lit("")))
        .when(decimal_comma, F.replace(raw, F.lit(","), F.lit(".")))
        .otherwise(F.replace(raw, F.lit(","), F.lit("")))
    )
    return F.when(raw.isNotNull(), tidy.try_cast("decimal(18,4)"))


# fixed values: size systems with their patterns and what turns them into EU sizes
SIZES = [("US", r"(?i)\bUS\s*[-.]?\s*([0-9]{1,2}(?:\.5)?)\b", 33), ("EU", r"(?i)\b(?:EU|IT|FR)\s*[-.]?\s*([0-9]{2}(?:\.5)?)\b", None), ("UK", r"(?i)\bUK\s*[-.]?\s*([0-9]{1,2}(?:\.5)?)\b", 34)]
OTHER_SIZES = [("JP_CM", r"(?i)\b([0-9]{2}(?:\.[0-9])?)\s*cm\b"), ("JP", r"(?i)サイズ\s*([0-9]+|[SMLX]+)\b"), ("ALPHA", r"(?i)\b(XXS|XS|S|M|L|XL|XXL|XXXL)\b")]


def size(text: Column) -> Column:
    """Struct of marked, system, converted: the earliest of the numbered systems, else the first other that fits."""
    t = F.trim(F.coalesce(text, F.lit("")))
    numbered = []
    for system, pattern, plus in SIZES:
        number = F.regexp_extract(t, pattern, 1)
        marked = F.regexp_extract(t, pattern, 0)
        eu = F.concat(F.lit("EU "), F.bround(number.try_cast("double") + plus).cast("int")) if plus else F.lit(None).cast("string")
        numbered.append(F.when(number != "", F.struct(F.regexp_instr(t, F.lit(pattern)).alias("at"), marked.alias("marked"), F.lit(system).alias("system"), eu.alias("converted"))))
    first = F.array_min(F.array_compact(F.array(*numbered)))
    none = F.lit(None).cast("string")
    made = [F.when(first.isNotNull(), F.struct(first["marked"].alias("marked"), first["system"].alias("system"), first["converted"].alias("converted")))]
    for system, pattern in OTHER_SIZES:
        marked = F.regexp_extract(t, pattern, 0)
        made.append(F.when(marked != "", F.struct((F.upper(marked) if system == "ALPHA" else marked).alias("marked"), F.lit(system).alias("system"), none.alias("converted"))))
    mm = F.regexp_extract(t, r"\b([0-9]{3})\b", 0)
    made.append(F.when((mm != "") & t.contains("사이즈"), F.struct(mm.alias("marked"), F.lit("KR_MM").alias("system"), none.alias("converted"))))
    return F.coalesce(*made, F.struct(t.alias("marked"), none.alias("system"), none.alias("converted")))


# fixed values: how prices are shown
SIGNS = {"JPY": "¥", "EUR": "€", "USD": "$"}


def shown_price(value: Column, code: Column) -> Column:
    """A price for people: without trailing zeros, its sign or code before it, thousands set apart in yen only."""
    plain = F.regexp_replace(F.regexp_replace(value.cast("decimal(18,4)").cast("string"), "0+$", ""), r"\.$", "")
    yen = F.concat(F.lit("¥"), F.format_number(F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("long"), 0))
    text = F.when(code == "JPY", yen).when(code == "EUR", F.concat(F.lit("€"), plain)).when(code == "USD", F.concat(F.lit("$"), plain)).when(F.coalesce(code, F.lit("")) != "", F.concat_ws(" ", code, plain)).otherwise(plain)
    return F.when(value.isNotNull(), text).otherwise(F.nullif(code, F.lit("")))


def shown_size(marked: Column) -> Column:
    return F.when(marked != "", F.concat(F.lit("Size "), marked))


def weighted_mean(pairs: list[tuple[float, Column]]) -> Column:
    """Sum of weight times value over the sum of weights; null values leave with their weights."""
    top = reduce(lambda a, b: a + b, (F.coalesce(F.lit(w) * v, F.lit(0.0)) for w, v in pairs))
    bottom = reduce(lambda a, b: a + b, (F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in pairs))
    return F.try_divide(top, bottom)
