"""How a source may be reached for a query: path rules by longest prefix, and five strategies with a status and a reason each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

STRATEGIES = ["collection_slug", "site_search", "catalog_feed", "sitemap", "official_api"]
# fixed values: what marks the template of a site search
SEARCH_MARKS = ["/search", "?q=", "?s=", "{query}"]


def target(url: Column) -> Column:
    """Path and query of a URL; the path is `/` where there is none."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(F.when(path == "", "/").otherwise(path), F.regexp_extract(url, r"(\?[^#]+)", 1))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(source_id, url, ...) with prefix and allowed of the longest rule(source_id, prefix, allow) that begins its target.

    Where no rule fits, prefix is null and allowed true; of an allowing and a refusing rule alike the first holds. A `*`
    at the end of a prefix says nothing more. Targets are cut to the lengths that the source's rules have, and meet rules
    by equality: no URL is compared with every rule.
    """
    plain = rules.select("source_id", F.regexp_replace("prefix", r"\*$", "").alias("prefix"), "allow").where(F.col("prefix") != "")
    best = plain.groupBy("source_id", "prefix").agg(F.max("allow").alias("allow"))
    lengths = best.groupBy("source_id").agg(F.collect_set(F.length("prefix")).alias("_lengths"))  # lengths of paths
    cut = urls.withColumn("_target", target(F.col("url"))).join(lengths, "source_id", "left")
    cut = cut.withColumn("_n", F.explode_outer(F.filter("_lengths", lambda n: n <= F.length("_target")))).withColumn("_prefix", F.expr("left(_target, _n)"))
    met = cut.join(best.select("source_id", F.col("prefix").alias("_prefix"), "allow"), ["source_id", "_prefix"], "left")
    longest = F.max(F.when(F.col("allow").isNotNull(), F.struct(F.length("_prefix").alias("n"), F.col("_prefix").alias("prefix"), "allow")))
    out = met.groupBy(*urls.columns).agg(longest.alias("_r"))
    return out.select(*urls.columns, F.col("_r.prefix").alias("prefix"), F.coalesce("_r.allow", F.lit(True)).alias("allowed"))


def collection_slug(text: Column) -> Column:
    """The handle of a query's first two words, else of its first; null if there is none."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    two = F.when(F.size(words) >= 2, F.nullif(T.slug(F.array_join(F.slice(words, 1, 2), " ")), F.lit("")))
    return F.coalesce(two, F.nullif(T.slug(F.get(words, 0)), F.lit("")))


def _is_search(template: Column) -> Column:
    low = F.lower(template)
    marked = F.lit(False)
    for mark in SEARCH_MARKS:
        marked = marked | low.contains(mark)
    return marked & ~(template.contains("{slug}") & low.contains("/collection"))


def _is_collection(template: Column) -> Column:
    return (template.contains("{slug}") | F.lower(template).contains("/collection")) & ~_is_search(template)


def _filled(origin: Column, template: Column, slug: Column, text: Column) -> Column:
    return F.concat(origin, F.replace(F.replace(template, F.lit("{slug}"), slug), F.lit("{query}"), F.replace(F.url_encode(text), F.lit("%20"), F.lit("+"))))


def _listed(names: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(names)
    many = F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(names, -1))
    return F.when(n == 1, F.get(names, 0)).when(n == 2, F.array_join(names, " and ")).otherwise(many)


def plan(asked: DataFrame, sources: DataFrame, rules: DataFrame) -> DataFrame:
    """asked(query_id, source_id, text) to query_id, source_id, strategy, status, reason, urls: five rows each.

    sources(source_id, origins, query_paths, sitemaps: arrays; feed_path, page_size, may_search, product, signup_url,
    keys: map of key names to values). rules(source_id, prefix, allow). A strategy is queued with the URLs that the rules
    allow, blocked if they allow none of them, skipped if it does not apply. A catalogue feed is never read from /search.
    """
    q = asked.withColumn("text", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))).join(sources, "source_id")
    slug, empty = collection_slug(F.col("text")), F.col("text") == ""
    none = F.array().cast("array<string>")
    each = lambda kept, make: F.array_distinct(F.flatten(F.transform("origins", lambda o: F.transform(F.filter("query_paths", kept), lambda t: make(o, t)))))
    collections = F.when(empty | slug.isNull(), none).otherwise(each(_is_collection, lambda o, t: _filled(o, t, slug, F.col("text"))))
    searches = F.when(empty | ~F.col("may_search"), none).otherwise(F.array_distinct(F.transform(F.filter("query_paths", _is_search), lambda t: _filled(F.get("origins", 0), t, F.coalesce(slug, F.lit("")), F.col("text")))))
    feed = F.col("feed_path")
    page = F.concat(F.when(feed.startswith("/"), feed).otherwise(F.concat(F.lit("/"), feed)), F.when(feed.contains("?"), "&").otherwise("?"), F.lit("limit="), F.greatest("page_size", F.lit(1)).cast("string"), F.lit("&page=1"))
    feeds = F.when(empty | feed.isNull(), none).otherwise(F.transform("origins", lambda o: F.concat(o, page)))
    q = q.withColumn("_urls", F.map_from_arrays(F.array(*(F.lit(s) for s in STRATEGIES[:4])), F.array(collections, searches, feeds, F.array_distinct(F.coalesce("sitemaps", none)))))
    rows = q.select("query_id", "source_id", F.explode("_urls").alias("strategy", "_u")).select("query_id", "source_id", "strategy", F.posexplode("_u").alias("at", "url"))
    searched = F.lower(F.regexp_extract(target(F.col("url")), "^[^?]*", 0))
    by_kind = (F.col("strategy") != "catalog_feed") | ~((searched == "/search") | searched.startswith("/search/"))
    judged = ruled(rows, rules).withColumn("allowed", F.col("allowed") & by_kind)
    why = F.when(searched.contains("/search"), "robots Disallow: /search").when(F.col("prefix").isNotNull(), "recorded disallowed path prefix").otherwise("url is not admitted")
    of = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(F.col("allowed") == ok, F.struct("at", "url", why.alias("why"))))), lambda x: x)  # noqa: E731  a strategy's own URLs
    met = judged.groupBy("query_id", "source_id", "strategy").agg(of(True).alias("good"), of(False).alias("bad"))
    every = q.select("query_id", "source_id", "text", "may_search", "feed_path", "sitemaps", "keys", "product", "signup_url", slug.alias("slug"), F.explode(F.array(*(F.lit(s) for s in STRATEGIES))).alias("strategy"))
    out = every.join(met, ["query_id", "source_id", "strategy"], "left")
    s, name = F.col("strategy"), F.col("source_id")
    missing = F.array_sort(F.map_keys(F.map_filter("keys", lambda _, v: F.trim(F.coalesce(v, F.lit(""))) == "")))
    has_key = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), _listed(missing), F.lit(". Create "), F.col("product"), F.lit(" credentials at "), F.col("signup_url"))).otherwise(F.concat("product", F.lit(" credentials are set but the official API client is not implemented. Docs: "), F.col("signup_url")))
    skipped = (
        F.when(s == "official_api", F.when(F.col("keys").isNull(), F.concat(name, F.lit(" publishes no official API"))).otherwise(has_key))
        .when((s == "collection_slug") & F.col("text").eqNullSafe(""), "no query text from which to derive a collection handle")
        .when(s == "collection_slug", "no collection handle could be derived from the query")
        .when((s == "site_search") & ~F.col("may_search"), F.concat(F.lit("search is not an admitted use of "), name))
        .when((s == "site_search") & (F.col("text") == ""), "no query text")
        .when(s == "site_search", F.concat(name, F.lit(" publishes no admitted site-search path")))
        .when((s == "catalog_feed") & F.col("feed_path").isNull(), F.concat(name, F.lit(" publishes no catalogue feed")))
        .when(s == "catalog_feed", "no query text to match against the catalogue feed")
        .otherwise(F.concat(name, F.lit(" declares no sitemap")))
    )
    queued = F.when(s == "collection_slug", "guessed collection handle from the query").when(s == "site_search", "admitted site search").when(s == "catalog_feed", "shop-wide product feed, independent of collection handles").otherwise("robots-allowed sitemap")
    some, blocked = F.size(F.coalesce("good.url", none)) > 0, F.size(F.coalesce("bad.url", none)) > 0
    return out.select(
        "query_id", "source_id", "strategy", F.when(some, "queued").when(blocked, "blocked").otherwise("skipped").alias("status"),
        F.when(some, queued).when(blocked, F.get("bad.why", 0)).otherwise(skipped).alias("reason"), F.when(some, F.col("good.url")).otherwise(F.coalesce("bad.url", none)).alias("urls"),
    )


def seeds(planned: DataFrame) -> DataFrame:
    """query_id, source_id, url of what is queued, each URL once by the first strategy that names it; feeds are paged elsewhere."""
    order = F.array_position(F.array(*(F.lit(s) for s in STRATEGIES)), F.col("strategy"))
    rows = planned.where((F.col("status") == "queued") & (F.col("strategy") != "catalog_feed")).select("query_id", "source_id", "strategy", order.alias("_o"), F.explode("urls").alias("url"))
    return rows.groupBy("query_id", "source_id", "url").agg(F.min_by("strategy", "_o").alias("strategy"))


def detail(attempts: DataFrame) -> DataFrame:
    """(query_id, source_id, strategy, status, reason, yielded) to one line a source: what each strategy gave, or why nothing."""
    order = F.array_position(F.array(*(F.lit(s) for s in STRATEGIES)), F.col("strategy"))
    said = F.when(F.col("yielded") > 0, F.concat("strategy", F.lit(": "), F.col("yielded").cast("string"))).when(F.col("status").isin("skipped", "blocked"), F.concat("strategy", F.lit(": "), "status", F.lit(" ("), "reason", F.lit(")"))).otherwise(F.concat("strategy", F.lit(": 0 ("), "reason", F.lit(")")))
    rows = attempts.groupBy("query_id", "source_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), said.alias("s")))).alias("x"))  # five
    return rows.select("query_id", "source_id", F.array_join("x.s", "; ").alias("detail"))
