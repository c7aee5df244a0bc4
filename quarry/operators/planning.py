"""From a request to queries: user text, hypotheses, drafts, gains, sources, admission."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType, _parse_datatype_string

from quarry.functions import scores as S
from quarry.functions import text as T
from quarry.functions import url as U

# fixed values: words for colours, materials and categories
COLOURS = ["black", "white", "red", "blue", "green", "brown", "beige", "grey", "gray", "pink", "purple", "yellow", "orange", "silver", "gold", "cream", "navy"]
MATERIALS = ["leather", "suede", "canvas", "wool", "silk", "cotton", "denim", "nylon", "cashmere", "velvet", "linen"]
CATEGORIES = {"boot": "footwear", "boots": "footwear", "shoe": "footwear", "shoes": "footwear", "sneaker": "footwear", "sneakers": "footwear", "bag": "bag", "handbag": "bag", "coat": "outerwear", "jacket": "outerwear", "dress": "dress", "ring": "jewellery", "necklace": "jewellery", "watch": "watch"}
SIZE_MARKS = ["us", "uk", "eu", "it", "fr", "size"]

REQUEST = StructType([StructField("year", IntegerType()), StructField("colours", ArrayType(StringType())), StructField("materials", ArrayType(StringType())), StructField("category", StringType()), StructField("brand", StringType()), StructField("model", StringType())])


def read_request(text: str | None) -> dict:
    """Year, colours, materials, category; the first other word is the brand, the rest the model.

    A four-digit year beats a two-digit one (30 and below are after 2000); numbers after a size mark are sizes.
    """
    words = re.findall(r"[a-z0-9]+", (text or "").lower())
    out = {"year": None, "colours": [], "materials": [], "category": None, "brand": None, "model": None}
    rest, short, skip = [], None, False
    for w in words:
        if skip and w.isdigit():
            skip = False
            continue
        skip = w in SIZE_MARKS
        if skip:
            continue
        if re.fullmatch(r"(19|20)\d\d", w):
            out["year"] = out["year"] or int(w)
        elif re.fullmatch(r"\d\d", w):
            short = short or int(w) + (2000 if int(w) <= 30 else 1900)
        elif w in COLOURS:
            out["colours"].append(w)
        elif w in MATERIALS:
            out["materials"].append(w)
        elif w in CATEGORIES:
            out["category"] = out["category"] or CATEGORIES[w]
        elif w not in T.STOP:
            rest.append(w)
    out["year"] = out["year"] or short
    out["brand"], out["model"] = (rest[0] if rest else None), " ".join(rest[1:]) or None
    return out


@F.pandas_udf(REQUEST)
def request_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_request(t) for t in texts], columns=[f.name for f in REQUEST])


#: Kinds of query by round: (round, family, pattern, cost, novelty). Pattern fields are columns of a hypothesis.
DRAFTS = [
    (0, "exact", "{brand} {model}", 0, 1.0), (0, "exact", "{brand} {model} {year}", 0, 0.9), (1, "category", "{brand} {category}", 1, 0.8), (1, "attributes", "{brand} {model} {colour}", 1, 0.7), (2, "attributes", "{brand} {material} {category}", 1, 0.6),
    (2, "code", "{code}", 0, 0.9), (3, "visual", "{colour} {material} {category}", 2, 0.5), (4, "season", "{brand} {season} {category}", 2, 0.4), (5, "negative", "{brand} {model} replica", 2, 0.3),
]
FIELDS = ["brand", "model", "year", "category", "colour", "material", "code", "season"]


def drafts(hypotheses: DataFrame) -> DataFrame:
    """A query for each kind whose fields a hypothesis has; equal texts of a search once, the earliest round first."""
    made = []
    for round_, family, pattern, cost, novelty in DRAFTS:
        used = re.findall(r"{(\w+)}", pattern)
        parts = [F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in pattern.split()]
        there = F.lit(True)
        for u in used:
            there = there & F.col(u).isNotNull() & (F.col(u).cast("string") != "")
        made.append(F.when(there, F.struct(F.lit(round_).alias("round"), F.lit(family).alias("family"), F.lower(F.concat_ws(" ", *parts)).alias("text"), F.lit(cost).alias("cost"), F.lit(novelty).alias("novelty"))))
    rows = hypotheses.select("search_id", "id", "posterior", F.explode(F.array_compact(F.array(*made))).alias("q")).select("search_id", "id", "posterior", "q.*")
    one = rows.groupBy("search_id", "text").agg(F.min_by(F.struct("id", "posterior", "round", "family", "cost", "novelty"), F.struct("round", -F.col("posterior"), "id")).alias("q"))
    return one.select("search_id", "text", "q.*")


def with_gain(queries: DataFrame, prior: DataFrame, sources: Column) -> DataFrame:
    """gain: less where a query is near one that ran before in its search; those meet on a shared word."""
    words = lambda df, name: df.select("search_id", F.col("text").alias(name), T.words_of(F.col("text")).alias(f"{name}_w"))
    a, b = words(queries, "text"), words(prior, "past")
    met = a.withColumn("w", F.explode("text_w")).join(b.withColumn("w", F.explode("past_w")), ["search_id", "w"])
    overlap = met.groupBy("search_id", "text").agg(F.max(T.jaccard(F.col("text_w"), F.col("past_w"))).alias("overlap"))
    rows = queries.join(overlap, ["search_id", "text"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    return rows.withColumn("gain", S.information_gain(F.col("posterior"), F.col("novelty"), F.col("overlap"), sources, F.col("cost")))


def drop_demoted(queries: DataFrame, demoted: DataFrame) -> DataFrame:
    """Queries that hold no demoted term of their search; terms are words, so they meet by equality."""
    words = queries.select("search_id", "text", F.explode(T.words_of(F.col("text"))).alias("term"))
    hit = words.join(demoted.select("search_id", F.lower("term").alias("term")), ["search_id", "term"], "left_semi").select("search_id", "text").distinct()
    return queries.join(hit, ["search_id", "text"], "left_anti")


def source_queries(queries: DataFrame, admitted: DataFrame, most: int = 4) -> DataFrame:
    """Queries for each source that takes their language, the `most` with the highest gain."""
    met = queries.join(admitted, "language")
    w = Window.partitionBy("search_id", "source_id").orderBy(F.desc("gain"), "text")
    return met.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def already_run(queries: DataFrame, sources: DataFrame, ran: DataFrame) -> DataFrame:
    """Pairs of a query and a source that have not run under the same versions."""
    keyed = queries.crossJoin(F.broadcast(sources)).withColumn("key", F.sha2(F.concat_ws("|", "source_id", T.normal_query(F.col("text")), "versions"), 256))  # sources are a fixed registry
    return keyed.join(ran.select("key"), "key", "left_anti")


def coverage_reason(rows: DataFrame) -> DataFrame:
    """outcome and detail for each source that is not asked; both null for those that are. The first reason counts.

    rows: known, selected, enabled, include_disabled, needs_credential, admission, languages and asked (arrays), general,
    health (what a source's record forbids, or null), unavailable (outcome or null), budget_left.
    """
    opted = ~F.col("include_disabled")
    fits = (F.size("asked") == 0) | (F.size("languages") == 0) | F.arrays_overlap("asked", "languages") | F.array_contains("languages", "en") | F.col("general")
    reasons = [
        (~F.col("known"), F.lit("UNMEASURABLE"), "manifest lookup failed"), (~F.col("selected"), F.lit("NOT_ATTEMPTED"), "family not selected"), (opted & ~F.col("enabled"), F.lit("BLOCKED_BY_POLICY"), "source disabled"), (opted & F.col("needs_credential"), F.lit("AUTH_REQUIRED"), "operator credential required"),
        (F.col("admission") == "BLOCKED", F.lit("BLOCKED_BY_POLICY"), "source admission blocked"), (~fits, F.lit("NOT_ATTEMPTED"), "language mismatch"), (F.col("health").isNotNull(), F.col("health"), "health forbids planning"), (F.col("unavailable").isNotNull(), F.col("unavailable"), "adapter unavailable"), (~F.col("budget_left"), F.lit("UNMEASURABLE"), "source budget exhausted"),
    ]
    first = F.coalesce(*(F.when(c, F.struct(outcome.alias("outcome"), F.lit(detail).alias("detail"))) for c, outcome, detail in reasons))
    return rows.withColumn("_r", first).select(*rows.columns, F.col("_r.outcome").alias("outcome"), F.col("_r.detail").alias("detail"))


# fixed values: which sources can be asked in a language
ADMITTED_SOURCES = {
    "en": ["searxng", "wikipedia", "marginalia", "internet_archive", "openverse", "ebay_browse_api", "therealreal", "rebag", "byronesque", "heroine"], "ja": ["komehyo", "kind", "wikipedia_ja"], "ko": ["wikipedia_ko"], "zh": ["wikipedia_zh"], "fr": ["wikipedia_fr"], "it": ["wikipedia_it"], "ru": ["wikipedia_ru"],
}


def admitted_sources(language: Column) -> Column:
    """Sources of a language in order; none for one that is not known."""
    table = F.create_map(*(x for k, v in ADMITTED_SOURCES.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
    return F.coalesce(F.try_element_at(table, language), F.array().cast("array<string>"))


def source_forms(language: Column, brand: Column, model: Column, condition: Column, category: Column, most: int = 4) -> Column:
    """Structs of source and text: how a query is put to the first `most` sources of its language. Without brand and model there is none."""
    say = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p != "", F.lit(False))), " ")
    core = F.trim(say(brand, model))

    def form(source: Column) -> Column:
        shop = source.isin("komehyo", "kind") & F.coalesce(condition != "", F.lit(False))
        text = F.when(source.startswith("wikipedia") | (source == "ebay_browse_api"), core).when(shop, say(core, condition)).otherwise(F.trim(say(core, category, condition)))
        return F.struct(source.alias("source"), text.alias("text"))

    forms = F.transform(F.slice(admitted_sources(language), 1, most), form)
    return F.when(core != "", forms).otherwise(F.slice(forms, 1, 0))


def robots_rules(body: str | None, agent: str = "*") -> list[tuple[str, bool]]:
    """(path prefix, allowed) of the group for the agent."""
    rules, mine = [], False
    for line in (body or "").splitlines():
        name, _, value = (x.strip() for x in line.partition("#")[0].partition(":"))
        if name.lower() == "user-agent":
            mine = value.lower() in (agent.lower(), "*")
        elif mine and name.lower() in ("allow", "disallow") and (value or name.lower() == "allow"):
            rules.append((value, name.lower() == "allow"))
    return rules


def robots_allow(rules: list[tuple[str, bool]], path: str) -> bool:
    """The longest prefix decides, allowing wins a tie; nothing said is allowed."""
    hits = [(len(p), ok) for p, ok in rules if path.startswith(p)]
    return max(hits)[1] if hits else True


@F.pandas_udf(BooleanType())
def _robots(bodies: pd.Series, paths: pd.Series) -> pd.Series:
    return pd.Series([b is not None and robots_allow(robots_rules(b), p or "/") for b, p in zip(bodies, paths, strict=True)])


def admission(urls: DataFrame) -> DataFrame:
    """outcome of each url beside enabled, blocked, prefixes, robots (body, null if it could not be read).

    In order: a disabled source, a recorded block, an unsafe address, a path outside the source's, robots; a robots file
    that could not be read forbids.
    """
    path = F.regexp_extract("url", "^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    inside = F.exists("prefixes", lambda p: F.startswith(path, p))
    reason = (
        F.when(~F.col("enabled"), "DISABLED").when(F.col("blocked"), "BLOCKED_BY_ACCESS").when(U.is_malicious(F.col("url")), "BLOCKED_BY_POLICY")
        .when(~inside, "BLOCKED_BY_POLICY").when(~_robots("robots", path), "BLOCKED_BY_POLICY").otherwise("ADMITTED")
    )
    return urls.withColumn("outcome", reason)


def update_belief(beliefs: DataFrame, news: DataFrame) -> DataFrame:
    """beliefs(key, value, confidence, history) with the strongest of each key's news; what was before goes to the history."""
    best = news.groupBy("key").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", "value")).alias("n"))
    rows = beliefs.join(best, "key", "left")
    better = F.col("n.confidence") > F.col("confidence")
    return rows.select(
        "key", F.when(better, F.col("n.value")).otherwise(F.col("value")).alias("value"), F.when(better, F.col("n.confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(better, F.array_append("history", F.struct(F.col("value"), F.col("confidence")))).otherwise(F.col("history")).alias("history"),
    )


def translate(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows(term, language, ...) with translated and confidence from terms(term, language, translated), a short table; null if it has none."""
    known = terms.select(F.lower("term").alias("_term"), F.col("language").alias("_language"), "translated", F.lit(0.8).alias("confidence"))
    return rows.join(F.broadcast(known), (F.lower("term") == F.col("_term")) & (F.col("language") == F.col("_language")), "left").drop("_term", "_language")  # a row for each known term and language


def evidence_gaps(wanted: list[str], seen: Column, most: int = 8) -> Column:
    """Views still to ask for, in order of priority."""
    return F.slice(F.array_except(F.array(*(F.lit(w) for w in wanted)), seen), 1, most)


def seed_portfolio(requests: DataFrame, ceiling: int = 8) -> DataFrame:
    """Competing hypotheses of each request: as read, without model, without year, brand only; weights as shares."""
    r = requests.withColumn("r", request_of("text"))
    base = [F.col(f"r.{c}").alias(c) for c in ("brand", "model", "year", "category")]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kinds = [(0.5, base), (0.25, [base[0], base[1], none("year", "int"), base[3]]), (0.15, [base[0], none("model", "string"), base[2], base[3]]), (0.1, [base[0], none("model", "string"), none("year", "int"), base[3]])]
    made = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(p).alias("prior"), *cols) for i, (p, cols) in enumerate(kinds)))
    rows = r.select("search_id", F.explode(made).alias("h")).select("search_id", "h.*")
    one = rows.groupBy("search_id", "brand", "model", "year", "category").agg(F.min("id").alias("id"), F.sum("prior").alias("prior"))
    w = Window.partitionBy("search_id")
    top = one.withColumn("n", F.row_number().over(w.orderBy(F.desc("prior"), "id"))).where(F.col("n") <= ceiling)
    return top.withColumn("posterior", F.bround(F.col("prior") / F.sum("prior").over(w), 4)).drop("n", "prior")


def replanned(gaps: DataFrame, ran: DataFrame, most: int) -> DataFrame:
    """One turn of the loop from gaps to queries: gaps(search_id, view, gain) that no query has asked for yet, the `most` best of each search.

    ran(search_id, view). A caller goes on while a turn gives rows and its budget lasts.
    """
    w = Window.partitionBy("search_id").orderBy(F.desc("gain"), "view")
    fresh = gaps.join(ran.select("search_id", "view").distinct(), ["search_id", "view"], "left_anti")
    return fresh.groupBy("search_id", "view").agg(F.max("gain").alias("gain")).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= most)


def map_by_host(rows: DataFrame, host: str, order: str, make: Callable[[], Callable[[dict], object]], result: str, kind: str) -> DataFrame:
    """`rows` with column `result`: a host's rows lie together and are taken in order; `make` gives each task a function of a row."""
    schema = StructType([*rows.schema.fields, *_parse_datatype_string(f"{result} {kind}").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make()
        for pdf in batches:
            yield pdf.assign(**{result: [f(r) for r in pdf.to_dict("records")]})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, host).sortWithinPartitions(host, order).mapInPandas(run, schema)
