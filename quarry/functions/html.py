"""HTML, structured data and page states as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import udfs

# fixed values: formats of dates, the first that fits counts
DATES = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMM dd, yyyy", "dd MMM yyyy"]
# fixed values: words for availability
AVAILABLE = {
    "LIVE": "LIVE", "INSTOCK": "LIVE", "IN_STOCK": "LIVE", "HTTPS://SCHEMA.ORG/INSTOCK": "LIVE",
    "SOLD": "SOLD", "SOLDOUT": "SOLD", "OUTOFSTOCK": "SOLD", "HTTPS://SCHEMA.ORG/SOLDOUT": "SOLD", "HTTPS://SCHEMA.ORG/OUTOFSTOCK": "SOLD",
    "RESERVED": "RESERVED", "PENDING": "RESERVED", "REMOVED": "REMOVED", "DISCONTINUED": "REMOVED", "UNKNOWN": "UNKNOWN",
}
SOLD_WORDS = "sold|ended|売り切れ|売却済|落札済|판매완료|已售|vendu|venduto|продано"
RESERVED_WORDS = "reserved|取引中|예약|réservé|riservato"
SOLD_MARKS = r"(?i)\bsold\b|this listing has ended|no longer available|売り切れ|売却済|落札済|판매완료|판매 완료|已售|卖完|\bvendu\b|\bvenduto\b|продано|sold out"
RESERVED_MARKS = r"(?i)\breserved\b|取引中|仮押さえ|예약|réservé|riservato"
SCHEMA_STATE = r"(?i)schema\.org/(InStock|OutOfStock|SoldOut|LimitedAvailability|OnlineOnly|PreOrder|Discontinued|InStoreOnly)"
SOFT_ERRORS = ["404 not found", "page not found", "404 - not found", "not found", "410 gone", "no longer available", "this listing has ended", "sorry, this page"]
CHALLENGES = ["just a moment", "attention required", "cf-browser-verification", "cf-challenge", "checking your browser", "enable javascript and cookies", "sorry, you have been blocked", "access denied", "unusual traffic", "captcha", "hcaptcha", "recaptcha", "verify you are human", "are you a robot"]
BLOCKED = ["BLOCKED_BY_ACCESS", "AUTH_REQUIRED", "RATE_LIMITED", "BLOCKED_BY_POLICY"]
LEAST_CHARS = 300


# fixed values: entities that pages are known to hold, in the order in which they are replaced
NAMED = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def strip_html(html: Column) -> Column:
    """Tags become spaces, entities characters, runs of white space one space."""
    text = udfs.unescaped(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))
    return F.trim(F.regexp_replace(text, r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f\x85]+", " "))


def strip_named(html: Column) -> Column:
    """As `strip_html`, for the named entities alone, each closed by its semicolon: what is cut off stays as it is, and no text enters Python."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in NAMED.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[\t\n\f\r \u00a0]+", " "))


def visible_body(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")


def parse_date(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATES)).cast("date")


def availability(raw: Column) -> Column:
    low = F.lower(raw)
    table = F.create_map(*(F.lit(x) for kv in AVAILABLE.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(raw))), F.when(low.rlike(SOLD_WORDS), "SOLD"), F.when(low.rlike(RESERVED_WORDS), "RESERVED"), F.lit("UNKNOWN"))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))


def sitemap_locations(xml: Column, limit: int = 200) -> Column:
    return F.slice(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), 1, limit)


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by property or name, in either order of attributes; null if there is none."""
    q = name.replace(".", r"\.")
    forth = F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:property|name)=["']{q}["'][^>]*content=["']([^"']*)["']""", 1)
    back = F.regexp_extract(html, rf"""(?is)<meta[^>]+content=["']([^"']*)["'][^>]*(?:property|name)=["']{q}["']""", 1)
    return F.coalesce(F.nullif(forth, F.lit("")), F.nullif(back, F.lit("")))


def itemprop(html: Column, name: str) -> Column:
    content = F.regexp_extract(html, rf"""(?is)itemprop=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    body = F.regexp_extract(html, rf"""(?is)itemprop=["']{name}["'][^>]*>([^<]*)<""", 1)
    return F.coalesce(F.nullif(content, F.lit("")), F.nullif(F.trim(body), F.lit("")))


def element(html: Column, tag: str) -> Column:
    return F.nullif(strip_html(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)), F.lit(""))


PRODUCT = "name string, brand string, description string, url string, image string, offers string"


def json_ld_product(html: Column) -> Column:
    """The first JSON-LD block as a product; brand, image and offers stay JSON where they are objects or lists."""
    return F.from_json(F.regexp_extract(html, r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", 1), PRODUCT)


def json_ld_items(html: Column) -> Column:
    """URLs of an ItemList block, in order."""
    block = F.regexp_extract(html, r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    listed = F.from_json(block, "itemListElement array<struct<url string, item struct<url string>>>")["itemListElement"]
    return F.array_compact(F.transform(listed, lambda e: F.coalesce(e["url"], e["item"]["url"])))


def schema_state(html: Column) -> Column:
    word = F.lower(F.regexp_extract(html, SCHEMA_STATE, 1))
    return F.when(word.isin("instock", "limitedavailability", "onlineonly", "preorder", "instoreonly"), "LIVE").when(word.isin("outofstock", "soldout"), "SOLD").when(word == "discontinued", "REMOVED")


def liveness(status: Column, html: Column, outcome: Column) -> Column:
    """Availability of a fetched page; what was blocked is unknown, never sold."""
    body = F.coalesce(html, F.lit(""))
    seen = visible_body(body)
    return (
        F.when(outcome.isin(BLOCKED), "UNKNOWN")
        .when(status.isin(404, 410), "REMOVED")
        .when((status == 200) & schema_state(body).isNotNull(), schema_state(body))
        .when((status == 200) & seen.rlike(SOLD_MARKS), "SOLD")
        .when((status == 200) & seen.rlike(RESERVED_MARKS), "RESERVED")
        .when((status == 200) & (F.length(F.trim(seen)) < LEAST_CHARS), "UNKNOWN")
        .when(status == 200, "LIVE")
        .otherwise("UNKNOWN")
    )


def is_soft_error(html: Column) -> Column:
    """An error page sent as a success: an error phrase in the title, or in a short body."""
    head = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, 4096))
    title = F.regexp_extract(head, r"(?s)<title[^>]*>(.*?)</title", 1)
    return title.rlike("|".join(SOFT_ERRORS)) | ((F.length(head) < 1200) & head.rlike("|".join(SOFT_ERRORS[:6])))


def is_challenge(text: Column) -> Column:
    return F.lower(text).rlike("|".join(CHALLENGES))


def http_outcome(status: Column, body: Column) -> Column:
    """Source outcome of a response; a block or failure is never an empty search."""
    return (
        F.when(status.isNull(), "FAILED")
        .when(status.isin(401, 407), "AUTH_REQUIRED")
        .when(status == 429, "RATE_LIMITED")
        .when((status == 403) | is_challenge(F.coalesce(body, F.lit(""))), "BLOCKED_BY_ACCESS")
        .when(status.isin(404, 410), "SEARCHED_NO_MATCH")
        .when(status >= 500, "FAILED")
        .when(status.between(200, 299), "SEARCHED_MATCHES_FOUND")
        .otherwise("UNMEASURABLE")
    )


# fixed values: paths of products and of lists of them
PRODUCT_PATH = r"(?i)/(?:products?|listing|listings|items?|itm|c/goods)/[^/]+/?(?:\.json)?$"
IN_COLLECTION = r"(?i)/collections/[^/]+/products/[^/]+/?(?:\.json)?$"
INDEX_PATHS = ["/collections/", "/category/", "/categories/", "/search", "/catalog", "/designers/"]


def is_index_url(url: Column) -> Column:
    """The URL itself names a feed, collection, search or sitemap."""
    path = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)), "/+$", "")
    named = F.lower(url).contains("sitemap") | path.endswith("products.json") | path.contains("/search")
    return named | (~path.rlike(IN_COLLECTION) & (path.contains("/collections/") | path.contains("/category/") | path.contains("/categories/")))


def is_product_url(url: Column, prefixes: list[str]) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    listed = F.lit(False)
    for p in prefixes:
        listed = listed | path.contains(p)
    return ~is_index_url(url) & (listed | path.rlike(IN_COLLECTION) | path.rlike(PRODUCT_PATH))


def json_blocks(html: Column) -> Column:
    """All JSON-LD blocks as an array of JSON texts: lists and graphs are taken apart."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    many = lambda j: F.from_json(j, "array<string>", {"mode": "PERMISSIVE"})
    graph = lambda j: F.get_json_object(j, "$.@graph")
    one = lambda j: F.when(F.trim(j).startswith("["), many(j)).when(graph(j).startswith("["), many(graph(j))).otherwise(F.array(F.trim(j)))
    return F.filter(F.flatten(F.transform(scripts, one)), lambda j: F.coalesce(j.startswith("{"), F.lit(False)))


def block_types(block: Column) -> Column:
    """Lower-cased types of a JSON-LD block; one or several."""
    raw = F.get_json_object(block, "$.@type")
    return F.transform(F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array_compact(F.array(raw))), F.lower)


def payload_class(html: Column) -> Column:
    """product or index by a JSON body or by JSON-LD types, an index before a product; null if neither says."""
    body = F.trim(F.coalesce(html, F.lit("")))
    json = body.startswith("{")
    feed = F.when(json & F.get_json_object(body, "$.products").startswith("["), "index").when(json & F.get_json_object(body, "$.product").startswith("{"), "product")
    blocks = json_blocks(body)
    types = F.flatten(F.transform(F.when((F.size(blocks) == 0) & json, F.array(body)).otherwise(blocks), block_types))
    index = F.exists(types, lambda t: t.rlike("itemlist|collectionpage|searchresultspage|offercatalog"))
    product = F.exists(types, lambda t: t.endswith("product") & ~t.contains("productgroup"))
    return F.coalesce(feed, F.when(F.coalesce(index, F.lit(False)), "index").when(F.coalesce(product, F.lit(False)), "product"))


def feed_class(html: Column) -> Column:
    body = F.trim(F.coalesce(html, F.lit("")))
    return F.when(body.startswith("{"), F.when(F.get_json_object(body, "$.products").startswith("["), "index").when(F.get_json_object(body, "$.product").startswith("{"), "product"))


def document_class(url: Column, html: Column, prefixes: list[str]) -> Column:
    """product, index or other: error pages first, then the URL's shape unless the body is plainly a feed, then the body, then the path."""
    body, path = F.coalesce(html, F.lit("")), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1))
    by_path = F.lit(False)
    for p in INDEX_PATHS:
        by_path = by_path | path.contains(p)
    return (
        F.when(is_soft_error(body), "other")
        .when(is_index_url(url), F.when(feed_class(body) == "product", "product").otherwise("index"))
        .when(is_product_url(url, prefixes), F.when(feed_class(body) == "index", "index").otherwise("product"))
        .when(F.lower(F.substring(F.ltrim(body), 1, 400)).rlike("<urlset|<sitemapindex"), "index")
        .otherwise(F.coalesce(payload_class(body), F.when(by_path, "index").otherwise("other")))
    )


def extract_listing(html: Column) -> Column:
    """Title, description, price, image: each from JSON-LD, else microdata, else OpenGraph, else the page itself."""
    ld = json_ld_product(html)

    def first(name: str, prop: str, graph: str, last: Column) -> Column:
        return F.coalesce(F.nullif(ld[name], F.lit("")), itemprop(html, prop), meta(html, graph), last)

    price = F.coalesce(F.get_json_object(ld["offers"], "$.price"), itemprop(html, "price"), meta(html, "product:price:amount"))
    image = F.nullif(F.regexp_extract(html, r"""(?is)<img[^>]+src=["']([^"']+)["']""", 1), F.lit(""))
    return F.struct(first("name", "name", "og:title", F.coalesce(element(html, "h1"), element(html, "title"))).alias("title"), first("description", "description", "og:description", meta(html, "description")).alias("description"), price.alias("price"), first("image", "image", "og:image", image).alias("image"))


def retry_after(value: Column, now: Column, most: int = 60) -> Column:
    """Seconds to wait, from seconds or an HTTP date, 0 to `most`."""
    seconds = F.coalesce(value.try_cast("double"), F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))) - F.unix_timestamp(now))
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), seconds))
