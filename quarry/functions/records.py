"""Canonical JSON, keys and digests, receipts, lineage, promotion, labels, uploads, field comparison: records as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import udfs
from quarry.functions.html import availability

Value = Column | str | dict


def _struct(fields: dict[str, Value]) -> Column:
    """Fields in the order of their names, nested ones too; a string names a literal."""
    made = {k: _struct(v) if isinstance(v, dict) else F.lit(v) if isinstance(v, str) else v for k, v in fields.items()}
    return F.named_struct(*(x for k in sorted(made) for x in (F.lit(k), made[k])))


def canonical(fields: dict[str, Value]) -> Column:
    """JSON with sorted keys and no spaces, nulls kept, other than ASCII escaped; only that needs Python."""
    json = F.to_json(_struct(fields), {"ignoreNullFields": "false"})
    return F.coalesce(udfs.canonical(F.when(json.rlike("[^\\x00-\\x7F]"), json)), json)


def digest(fields: dict[str, Value]) -> Column:
    return F.sha2(canonical(fields), 256)


VERSIONS = ["adapter_version", "model_version", "parameters", "schema_version", "policy_version"]


def cache_key(content_digest: Column, versions: dict[str, Value], index_schema: str, code_version: str) -> Column:
    """Of a content digest and the eight versions under which it was read."""
    return digest({"content_digest": content_digest, **{v: versions[v] for v in VERSIONS}, "index_schema": index_schema, "code_version": code_version})


def idempotency_key(task_type: Value, search_id: Value, inputs: Column, versions: dict[str, Value], parameters: dict[str, Value]) -> Column:
    return digest({"task_type": task_type, "search_id": search_id, "input_digests": inputs, **{v: versions[v] for v in ("adapter_version", "backend_version", "policy_version")}, "parameters": parameters})


def listing_digest(url: Column, title: Column, description: Column, images: Column, source: Value, listing_id: Column) -> Column:
    """What a listing says, whatever order its images come in."""
    return digest({"url": url, "title": title, "description": description, "images": F.sort_array(images), "source": source, "listing_id": listing_id})


def hypothesis_digest(category: Value, brand: Column, model: Column, line: Column, year: Column, colourway: Column, aliases: Column) -> Column:
    """What a hypothesis says, not which it is."""
    return digest({"category": category, "brand": brand, "model": model, "line": line, "year": year, "colourway": colourway, "aliases": F.sort_array(aliases)})


def sealed(receipts: DataFrame, columns: list[str]) -> DataFrame:
    """Receipts with the digest of the named columns, in which the receipt's type and predecessor belong."""
    return receipts.withColumn("digest", digest({c: F.col(c) for c in columns}))


def broken(receipts: DataFrame, columns: list[str]) -> DataFrame:
    """Receipts without a digest, or whose digest is another than their content's."""
    return receipts.where(~F.col("digest").eqNullSafe(digest({c: F.col(c) for c in columns})))


def lineage(inputs: Column, parents: Column, process: str, versions: dict[str, str]) -> Column:
    """Where derived evidence came from; null where neither inputs nor parents are named, which is no lineage."""
    some = (F.size(inputs) > 0) | (F.size(parents) > 0)
    given = {"adapter_version": "none", "backend_version": "none", "policy_version": "provisional-1"} | versions
    return F.when(some, F.struct(inputs.alias("input_digests"), parents.alias("derived_from"), F.lit(process).alias("process"), F.lit(False).alias("raw"), *(F.lit(v).alias(k) for k, v in given.items())))


# fixed values: zones of evidence and the moves between them
ZONES = ["incoming", "quarantine", "verified", "derived", "exports", "temporary"]
MOVES = ["incoming>quarantine", "incoming>verified", "incoming>derived", "quarantine>verified", "verified>derived", "derived>exports", "incoming>temporary", "temporary>quarantine"]


def promotion(source: Column, target: Column, accepted: Column, exists: Column, owned: Column) -> Column:
    """What becomes of a move: UNKNOWN_ZONE, REFUSED, HELD, FOREIGN (another campaign's evidence) or PROMOTED."""
    known = source.isin(ZONES) & target.isin(ZONES)
    return F.when(~known, "UNKNOWN_ZONE").when(~F.concat_ws(">", source, target).isin(MOVES), "REFUSED").when((target == "verified") & ~accepted, "HELD").when(~exists, "REFUSED").when(~owned, "FOREIGN").otherwise("PROMOTED")


# fixed values: labels that a fallback may and may not give
FORBIDDEN_LABELS = ["REAL", "AUTHENTICATED", "VERIFIED_GENUINE", "EXHAUSTIVE_SEARCH_COMPLETE"]
FALLBACK_LABELS = ["CANDIDATE", "DIAGNOSTIC", "PARTIAL", "BLOCKED", "UNMEASURABLE"]


def fallback_fault(label: Column) -> Column:
    """Null for a label that a fallback may give, else what is wrong with it."""
    return F.when(label.isin(FORBIDDEN_LABELS), "forbidden").when(~F.coalesce(label.isin(FALLBACK_LABELS), F.lit(False)), "unknown")


def fallback_label(label: Column) -> Column:
    """The label, or an error that ends the job."""
    return F.when(fallback_fault(label).isNull(), label).otherwise(F.raise_error(F.concat(F.lit("a fallback may not produce "), F.coalesce(label, F.lit("null")))))


# fixed values: first bytes of images that are taken, and of files that are refused, in hex
IMAGES = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp")]
REFUSED = [("3C3F786D6C", "xml"), ("3C737667", "svg"), ("25504446", "pdf"), ("3C21444F", "html"), ("3C68746D", "html"), ("4D5A", "executable"), ("7F454C46", "elf"), ("504B0304", "archive"), ("23212F", "script")]


def upload_fault(data: Column, name: Column, most_bytes: int, most_edge: int, most_pixels: int) -> Column:
    """Why an upload is refused, or null: name, size, kind and, for PNG, the edges its header states. The declared type is not believed."""
    head = F.hex(F.substring(data, 1, 24))
    kind, webp = media_type(data), F.lit(None).cast("string")
    width, height = (F.conv(F.substring(head, k, 8), 16, 10).cast("long") for k in (33, 41))
    png = (kind == "image/png") & (F.length(data) >= 24)
    out = F.when(F.coalesce(name.rlike(r"^[/\\~]|^.?:|\.\."), F.lit(False)), "path").when(F.coalesce(F.length(data), F.lit(0)) == 0, "empty").when(F.length(data) > most_bytes, "too_large")
    for prefix, label in REFUSED:
        out = out.when(head.startswith(prefix), label)
    return out.when(kind.isNull(), "unknown_kind").when(png & ((width == 0) | (height == 0)), "no_size").when(png & ((width > most_edge) | (height > most_edge)), "edge").when(png & (width * height > most_pixels), "pixels").otherwise(webp)


def media_type(data: Column) -> Column:
    """By first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    kinds = [F.when(head.startswith(prefix), kind) for prefix, kind in IMAGES]
    return F.coalesce(*kinds, F.when(head.startswith("52494646") & F.endswith(head, F.lit("57454250")), "image/webp"))


def squeezed(text: Column) -> Column:
    """Single spaces, folded case; null for nothing."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit(""))


def compared_price(text: Column) -> Column:
    """A price's digits without currency, separators and trailing zeros; what is no number stays as text."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "[,¥€$£]", ""), "JPY|USD|EUR|GBP|CNY", ""))
    number = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), bare.try_cast("decimal(38,10)").cast("string"))
    plain = F.regexp_replace(number, r"\.?0+$", "")
    return F.when(F.trim(text) == "", None).when(bare == "", None).otherwise(F.coalesce(F.nullif(F.when(number.contains("."), plain).otherwise(number), F.lit("")), F.when(number.isNotNull(), "0"), squeezed(text)))


def compared_images(urls: Column) -> Column:
    """URLs separated by | as a sorted set of scheme, host and path."""
    place = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#;]*)"
    key = lambda u: F.concat(F.lower(F.regexp_extract(u, place, 1)), F.lit("://"), F.lower(F.regexp_extract(u, place, 2)), F.regexp_extract(u, place, 3))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(F.split(urls, r"\|"), lambda u: F.trim(u) != ""), key))), "|"), F.lit(""))


def compared_availability(text: Column) -> Column:
    return F.when(F.trim(text) != "", availability(text))


# fixed values: keys that no public payload shows
PRIVATE_KEYS = ["path", "fixture_root", "image_paths"]


def public_payload(payload: Column) -> Column:
    """A map without the keys that stay private."""
    return F.map_filter(payload, lambda k, _: ~k.isin(PRIVATE_KEYS))


# fixed values: stages of work, cheap ones first, and those that are heavy
STAGES = ["cache", "hashes_and_metadata", "text_and_ocr", "global_embeddings", "deduplication", "local_part_extraction", "local_correspondence", "browser_rendering", "deliberative_vlm", "remote_model", "deep_authenticity"]
HEAVY = STAGES[5:]


def cost_ledger(events: DataFrame, search: str, order: str, stage: str) -> DataFrame:
    """search, cheap_first, refused: whether no heavy stage came before the first deduplication, and how many did."""
    first = events.groupBy(search).agg(F.min(F.when(F.col(stage) == "deduplication", F.col(order))).alias("_at"))
    early = F.col(stage).isin(HEAVY) & (F.col("_at").isNull() | (F.col(order) < F.col("_at")))
    sums = events.join(first, search).groupBy(search).agg(F.count_if(early).alias("refused"))
    return sums.select(search, (F.col("refused") == 0).alias("cheap_first"), "refused")
