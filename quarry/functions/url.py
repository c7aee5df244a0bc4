"""URLs as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track a visitor
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "gclsrc", "dclid",
    "msclkid", "mc_cid", "mc_eid", "igshid", "spm", "ref", "ref_", "referrer", "affiliate", "aff",
    "aff_id", "clickid", "cmpid", "campaign", "src", "source", "_ga", "_gl", "ncid", "icid",
]
# fixed values: where a listing's id stands, the first that matches counts
LISTING_IDS = [
    r"(?i)/itm/([0-9]+)",
    r"(?i)/listing/([0-9]+)",
    r"(?i)/items/([A-Za-z0-9_-]+)",
    r"(?i)/products/([A-Za-z0-9_-]+)",
    r"(?i)/product/([A-Za-z0-9_-]+)",
    r"(?i)/p/([A-Za-z0-9_-]+)",
    r"(?i)/shop/.+/products/([A-Za-z0-9_-]+)",
    r"(?i)/products/detail/([A-Za-z0-9_-]+)",
    r"(?i)/auction/([A-Za-z0-9_-]+)",
    r"[?&]id=([0-9]+)",
]
# scheme, host with port, path, query
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def is_url(value: Column) -> Column:
    return value.rlike("(?i)^https?://[^/?#]+")


def _place(authority: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@", ""), ":[0-9]*$", "")


def host(url: Column) -> Column:
    """Lower-cased host without user and port; empty if there is none."""
    return _place(F.regexp_extract(url, PARTS, 2))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of the value, which is made once however often `body` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    """Form encoding that keeps letters, digits and _ . - ~ only."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme (https if none is given) and host without user, no default port, fragment or tracking.

    A path ends without slash but for the root; parameters are decoded, sorted and encoded again, empty ones keep "=".
    Text without host stays as it is, trimmed.
    """
    full = lambda p: F.struct(p.alias("plain"), F.when(p.startswith("//"), F.concat(F.lit("https:"), p)).otherwise(p).alias("full"))
    cut = lambda x: F.struct(x["plain"].alias("plain"), *(F.regexp_extract(x["full"], PARTS, k).alias(n) for k, n in enumerate(("scheme", "authority", "path", "query"), 1)))
    return bound(bound(bound(bound(F.trim(url), full), cut), _parts), _tidy)


def _parts(x: Column) -> Column:
    port = F.nullif(F.regexp_extract(x["authority"], ":([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.struct(x["plain"].alias("plain"), F.lower(x["scheme"]).alias("scheme"), _place(x["authority"]).alias("name"), port.alias("port"), F.regexp_replace(x["path"], ";[^/]*$", "").alias("path"), x["query"].alias("query"))


def _tidy(x: Column) -> Column:
    usual = ((x["scheme"] == "http") & (x["port"] == 80)) | ((x["scheme"] == "https") & (x["port"] == 443))
    place = F.when(x["port"].isNull() | usual, x["name"]).otherwise(F.concat(x["name"], F.lit(":"), x["port"].cast("string")))
    path = F.when(x["path"].isin("", "/"), "/").otherwise(F.regexp_replace(x["path"], "/+$", ""))
    pieces = F.filter(F.split(x["query"], "&"), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(p.contains("="), F.substr(p, F.locate("=", p) + 1)).otherwise("")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    query = bound(joined, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    # a scheme is there where the whole fits
    return F.when((x["scheme"] != "") & (x["name"] != ""), F.concat(x["scheme"], F.lit("://"), place, path, query)).otherwise(x["plain"])


def listing_id(url: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in LISTING_IDS))


def is_private_address(name: Column) -> Column:
    """Loopback, link-local and private IPv4 ranges, and local names."""
    part = [F.regexp_extract(name, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", k).try_cast("int") for k in (1, 2)]
    a, b = part
    ranges = (a.isin(0, 10, 127)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    return F.coalesce(ranges, F.lit(False)) | name.isin("localhost", "::1", "[::1]") | name.rlike(r"\.(local|internal|localhost)$")


def is_malicious(url: Column) -> Column:
    """No http or https, no host, or a private one."""
    return ~F.coalesce(url.rlike("(?i)^https?://"), F.lit(False)) | (host(url) == "") | is_private_address(host(url))


def is_refused(url: Column, resolved: Column) -> Column:
    """Whether a fetch of the URL is refused: no web address, a user in it, or a private address, of its own or among `resolved`."""
    user = F.regexp_extract(url, PARTS, 2).contains("@")
    return is_malicious(url) | user | F.coalesce(F.exists(resolved, is_private_address), F.lit(False))


def work_key(source: Column, kind: Column, target: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, kind, canonical_url(target)), 256)
