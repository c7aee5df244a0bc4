"""Readers: product feeds, OCR tables, sitemaps, page tables, binary files; a registry of adapters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import text as T
from quarry.functions import url as U

FEED = "products array<struct<id bigint, title string, handle string, vendor string, product_type string, tags string, body_html string, images array<struct<src string>>, variants array<struct<price string, available boolean>>>>"
#: Columns of a member, whatever it was read from.
MEMBER = ["url", "title", "vendor", "price", "images", "available"]


def feed_members(bodies: DataFrame, body: str, origin: str) -> DataFrame:
    """A row for each product of JSON feed bodies; a body that is no feed gives none."""
    products = F.explode(F.from_json(F.col(body), FEED)["products"])
    rows = bodies.select(F.col(origin).alias("origin"), products.alias("p"))
    first = F.try_element_at("p.variants", F.lit(1))
    return rows.select(F.concat("origin", F.lit("/products/"), F.col("p.handle")).alias("url"), F.col("p.title").alias("title"), F.col("p.vendor").alias("vendor"), first["price"].alias("price"), F.transform("p.images", lambda i: i["src"]).alias("images"), F.coalesce(first["available"], F.lit(False)).alias("available"))


def members(pages: DataFrame, body: str, url: str, prefixes: list[str], hosts: list[str]) -> DataFrame:
    """url, member: from JSON-LD lists, else sitemap locations, else links; prefix and host must fit."""
    rows, b = pages.select(F.col(url).alias("url"), F.col(body).alias("body")), F.col("body")
    some = lambda found: U.bound(found, lambda a: F.when(F.size(a) > 0, a))
    found = F.coalesce(some(H.json_ld_items(b)), some(H.sitemap_locations(b)), H.links(b))
    root = F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)
    full = lambda m: F.when(m.startswith("/"), F.concat(root, m)).otherwise(m)

    def fits(m: Column) -> Column:
        path = F.regexp_extract(m, "^[a-z]+://[^/]+([^?]*)", 1)
        listed = F.lit(not prefixes)
        for p in prefixes:
            listed = listed | path.startswith(p)
        return (U.host(m).isin(hosts) if hosts else F.lit(True)) & listed

    # made and judged within the array: a filter of rows would make each member again
    kept = F.filter(F.transform(found, lambda m: U.canonical_url(full(m))), fits)
    return rows.select("url", F.explode(kept).alias("member")).distinct()


def expand(rows: DataFrame, queries: list[list[str]], seen: DataFrame, per_index: int, depth: Column, most_depth: int = 3) -> DataFrame:
    """rows(url, member) with a score and the reason for which a member is dropped; null reasons stay.

    Reasons in order: too deep, seen before, no hit, over the cap of its index.
    """
    from pyspark.sql import Window

    scored = rows.withColumn("score", T.match_score(queries, F.col("member")))
    marked = scored.join(seen.select(F.col("member"), F.lit(True).alias("_seen")).distinct(), "member", "left")
    reason = F.when(depth > most_depth, "max_depth").when(F.col("_seen"), "already_seen").when(F.col("score") == 0, "no_query_hit")
    placed = marked.withColumn("_r", reason).withColumn("_n", F.row_number().over(Window.partitionBy("url", F.col("_r").isNull()).orderBy(F.desc("score"), "member")))
    return placed.select("url", "member", "score", F.coalesce("_r", F.when(F.col("_n") > per_index, "index_cap")).alias("drop_reason"))


#: Most pages and promotions of a catalogue walk, for a source and for a campaign.
CAPS = {"pages_per_source": 64, "pages_per_campaign": 80, "promote_per_source": 24, "promote_per_campaign": 48}


def walk(pages: DataFrame, members_of: DataFrame, queries: list[list[str]], seen: DataFrame, disallowed: list[str], hosts: list[str], caps: dict[str, int] | None = None) -> DataFrame:
    """A catalogue walk over stored feed pages: url, source_id, score and drop_reason of every member; null reasons are promoted.

    pages(source_id, page, n_members) in order of page; members_of(source_id, page, url, haystack). A walk ends at its first
    empty page and at the caps on pages, of a source and of the campaign in order of source. Reasons in order: page not
    walked, other host, disallowed path, seen before, no hit, cap of the source, cap of the campaign. Promotion goes by
    score, then url.
    """
    from pyspark.sql import Window

    caps = CAPS | (caps or {})
    by_source = Window.partitionBy("source_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = pages.withColumn("_empty", F.max((F.col("n_members") == 0).cast("int")).over(by_source)).withColumn("_n", F.row_number().over(Window.partitionBy("source_id").orderBy("page")))
    open_ = open_.where((F.col("_empty") == 0) & (F.col("_n") <= caps["pages_per_source"]))
    walked = open_.orderBy("source_id", "page").limit(caps["pages_per_campaign"]).select("source_id", "page", F.lit(True).alias("_walked"))  # a top-k of pages
    path = F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)
    barred = path.startswith("/search")
    for p in disallowed:
        barred = barred | path.startswith(p)
    rows = members_of.join(F.broadcast(walked), ["source_id", "page"], "left").join(seen.select("url", F.lit(True).alias("_seen")).distinct(), "url", "left").withColumn("score", T.match_score(queries, F.col("haystack")))
    other = ~U.host(F.col("url")).isin(hosts) if hosts else F.lit(False)
    reason = F.when(F.col("_walked").isNull(), "page_cap").when(other, "off_host").when(barred, "disallowed").when(F.col("_seen"), "already_seen").when(F.col("score") == 0, "no_query_hit")
    marked = rows.withColumn("_r", reason).withColumn("_k", F.row_number().over(Window.partitionBy("source_id", F.col("_r").isNull()).orderBy(F.desc("score"), "url")))
    fit = F.col("_r").isNull() & (F.col("_k") <= caps["promote_per_source"])
    first = marked.where(fit).orderBy(F.desc("score"), "url").limit(caps["promote_per_campaign"]).select("source_id", "url", F.lit(True).alias("_first"))
    out = marked.join(F.broadcast(first), ["source_id", "url"], "left")  # at most the campaign's promotions
    return out.select("source_id", "url", "score", F.coalesce("_r", F.when(F.col("_k") > caps["promote_per_source"], "source_cap"), F.when(F.col("_first").isNull(), "campaign_cap")).alias("drop_reason"))


def ledger(walked: DataFrame) -> DataFrame:
    """drop_reason (null: promoted), n."""
    return walked.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


def ingest(products: DataFrame, described: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """products(url, title, images) with described(image, descriptor): listings with the descriptors of their first images, and counts of what was skipped.

    A product without images, or none of whose first `most` images could be described, is skipped and counted; images
    meet their descriptors by equality, so one failure stops nothing.
    """
    first = products.select("url", "title", F.size("images").alias("n"), F.posexplode_outer(F.slice("images", 1, most)).alias("at", "image"))
    found = first.join(described, "image", "left").groupBy("url", "title", "n").agg(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("at", "descriptor"))), lambda s: s["descriptor"])).alias("descriptors"))
    state = F.when(F.col("n") <= 0, "no_image").when(F.size("descriptors") == 0, "no_descriptor").otherwise("put")
    rows = found.withColumn("state", state)
    return rows.where(F.col("state") == "put").select("url", "title", "descriptors"), rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def cached(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """pages(url, body, status) with body from cache(canonical_url, etag, cached_body) where the server said that nothing changed; origin says which."""
    keyed = pages.withColumn("canonical_url", U.canonical_url(F.col("url"))).join(cache, "canonical_url", "left")
    same = (F.col("status") == 304) & F.col("cached_body").isNotNull()
    return keyed.select("url", "canonical_url", F.when(same, F.col("cached_body")).otherwise(F.col("body")).alias("body"), F.when(same, "cache").when(F.col("body").isNotNull(), "page").otherwise("none").alias("origin"))


def ocr_rows(raw: DataFrame) -> DataFrame:
    """Recognised words with confidence from 0 to 1; negative confidences are layout, not words."""
    return raw.where((F.col("conf") >= 0) & (F.trim("text") != "")).withColumn("text", F.trim("text")).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("conf") / 100)))


def ocr_table(spark: SparkSession, path: str) -> DataFrame:
    """text and confidence (0 to 1) from tables of recognised words; negative confidences are layout, not words."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string", quote="")
    return ocr_rows(raw).select("left", "top", "width", "height", "text", "confidence")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows named by the SHA-256 of their bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), "length", "content")


Adapter = Callable[[SparkSession, str], DataFrame]
_ADAPTERS: dict[str, Adapter] = {}


def register_adapter(name: str, adapter: Adapter) -> None:
    if name in _ADAPTERS:
        raise ValueError(f"an adapter named {name} is registered")
    _ADAPTERS[name] = adapter


def adapter(name: str) -> Adapter:
    """The reader registered under the name; KeyError names those there are."""
    if name not in _ADAPTERS:
        raise KeyError(f"no adapter {name}; there are {sorted(_ADAPTERS)}")
    return _ADAPTERS[name]


register_adapter("parquet", lambda spark, path: spark.read.parquet(path))
register_adapter("ocr", ocr_table)
register_adapter("objects", objects)
