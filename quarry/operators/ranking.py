"""Ranks within tabs, diversity, query selection, cascades and archives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.cluster import written

#: Cuts of the escalation cascade, cheap to dear.
CASCADE = [("broad", 500), ("normalised", 250), ("download", 100), ("parts", 50), ("deliberative", 15), ("deep", 10)]
#: Least gain a round of queries must promise, by its number.
ROUND_FLOORS = [0.0, 0.04, 0.06, 0.08, 0.10, 0.12]


def _starts(counts: DataFrame, tab: str, chunk: str, *counted: str) -> DataFrame:
    """counts(tab, chunk, n...) with the sums of the chunks before and, as `_all`, of all: a row for each chunk of a tab."""
    every = Window.partitionBy(tab)
    before = every.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = [x for c in counted for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before"), F.sum(c).over(every).alias(f"{c}_all"))]
    return counts.select(F.col(tab).alias("_tab"), F.col(chunk).alias("_chunk_of"), *sums)


def _with_starts(rows: DataFrame, starts: DataFrame, tab: str, chunk: str) -> DataFrame:
    return rows.join(starts, F.col(tab).eqNullSafe(F.col("_tab")) & (F.col(chunk) == F.col("_chunk_of"))).drop("_tab", "_chunk_of")


def rank_tab(rows: DataFrame, tab: str, keys: list[Column], tie: str) -> DataFrame:
    """rank: place in the tab by the keys, all descending, ties by `tie`.

    Rows are dealt by ranges of tab, keys and tie, written, and numbered within their range from where it starts in its
    tab, so that no task holds a tab; rows alike in all of these share a range. Hand over only the columns that are needed.
    """
    order = [*(k.desc() for k in keys), F.col(tie)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, F.col(tab), *order).withColumn("_range", F.spark_partition_id()))
    starts = _starts(dealt.groupBy(tab, "_range").agg(F.count(F.lit(1)).alias("_n")), tab, "_range", "_n")
    place = F.col("_n_before") + F.row_number().over(Window.partitionBy(tab, "_range").orderBy(*order))
    return _with_starts(dealt, starts, tab, "_range").withColumn("rank", place.cast("int")).drop("_range", "_n_before", "_n_all")


def real_keys() -> list[Column]:
    return [F.col(c) for c in ("item_lower", "auth_lower", "completeness", "live", "size_match", "coverage")] + [0.03 * F.col("price_fit")]


def possibly_keys() -> list[Column]:
    return [F.col("item_lower"), 1 - F.col("completeness"), *(F.col(c) for c in ("auth_lower", "live", "size_match", "coverage"))]


#: Ranks of a tab that one task numbers anew.
STRETCH = 65_536


def diversify(ranked: DataFrame, tab: str, family: str) -> DataFrame:
    """place: the first of every family keeps its order, repeats follow after all firsts. Ranks are each once in a tab.

    Firsts meet their rows by rank, so a family that many rows share is one partial minimum a task; places are counted
    within stretches of ranks, from where each starts.
    """
    firsts = ranked.groupBy(tab, family).agg(F.min("rank").alias("_first")).select(F.col(tab).alias("_tab"), "_first")
    marked = ranked.join(firsts, F.col(tab).eqNullSafe(F.col("_tab")) & (F.col("rank") == F.col("_first")), "left")
    marked = written(marked.withColumn("_repeat", F.col("_first").isNull()).withColumn("_stretch", F.floor(F.col("rank") / STRETCH)).drop("_tab", "_first"))
    counts = marked.groupBy(tab, "_stretch").agg(F.count_if(~F.col("_repeat")).alias("_f"), F.count_if(F.col("_repeat")).alias("_r"))
    nth = F.row_number().over(Window.partitionBy(tab, "_stretch", "_repeat").orderBy("rank"))
    place = F.when(F.col("_repeat"), F.col("_f_all") + F.col("_r_before")).otherwise(F.col("_f_before")) + nth
    rows = _with_starts(marked, _starts(counts, tab, "_stretch", "_f", "_r"), tab, "_stretch")
    return rows.withColumn("place", place.cast("int")).select(*ranked.columns, "place")


def cascade(rows: DataFrame, score: Column, tie: str) -> DataFrame:
    """stage: the last stage each row reaches; rows past the first cut leave. A top-k, so no full sort."""
    top = rows.orderBy(score.desc(), tie).limit(CASCADE[0][1])
    place = F.row_number().over(Window.orderBy(score.desc(), F.col(tie)))
    stage = F.lit(None).cast("string")
    numbered = top.withColumn("rank", place)
    for name, cut in CASCADE:
        stage = F.when(F.col("rank") <= cut, name).otherwise(stage)
    return numbered.withColumn("stage", stage)


def broad_cut(rows: DataFrame, score: str, tie: str, limit: int = 500, strong: float = 0.12, slack: float = 0.06) -> DataFrame:
    """The first `limit` by score with a reason for each that stays."""
    top = rows.orderBy(F.desc(score), tie).limit(limit)
    reason = F.when(F.col(score) >= strong, "above_recall_threshold").when(F.col(score) >= slack, "recall_slack")
    return top.withColumn("reason", reason).where(F.col("reason").isNotNull())


def enabled_rounds(queries: DataFrame, search: str) -> DataFrame:
    """(search, round): rounds up to the first whose best gain is below its floor; empty rounds are passed over."""
    floors = F.array(*(F.lit(x) for x in ROUND_FLOORS))
    best = queries.groupBy(search, "round").agg(F.max("gain").alias("best"))
    ok = (F.col("best") >= F.element_at(floors, F.col("round") + 1)).cast("int")
    w = Window.partitionBy(search).orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return best.withColumn("_ok", F.min(ok).over(w)).where(F.col("_ok") == 1).select(search, "round")


def select_queries(queries: DataFrame, search: str, per_family: int = 8, per_round: int = 16, in_all: int = 48) -> DataFrame:
    """Queries of enabled rounds in order of gain, within the limits by family, round and in all."""
    live = queries.join(enabled_rounds(queries, search), [search, "round"], "left_semi")
    order = [F.desc("gain"), F.col("cost"), F.col("text")]
    n = lambda *by: F.row_number().over(Window.partitionBy(search, *by).orderBy(*order))
    rows = live.withColumn("_f", n("family")).withColumn("_r", n("round")).where((F.col("_f") <= per_family) & (F.col("_r") <= per_round))
    return rows.withColumn("position", n()).where(F.col("position") <= in_all).drop("_f", "_r")


def language_repair(queries: DataFrame, search: str, languages: list[str], in_all: int = 48) -> DataFrame:
    """Every language gets one query if it has any; the weakest query of a language with several makes room.

    Chosen rows come first (position not null), the rest are spares. A group is one search's queries.
    """
    schema = queries.schema

    def repair(pdf):  # noqa: ANN001, ANN202
        chosen = pdf[pdf["position"].notna()].sort_values("position")
        spare = pdf[pdf["position"].isna()].sort_values(["gain", "text"], ascending=[False, True])
        for language in languages:
            if (chosen["language"] == language).any() or not (spare["language"] == language).any():
                continue
            new = spare[spare["language"] == language].head(1)
            if len(chosen) >= in_all:
                counts = chosen["language"].value_counts()
                crowded = chosen[chosen["language"].map(counts) > 1].sort_values(["gain", "position"])
                if not len(crowded):
                    continue
                chosen = chosen.drop(crowded.index[0])
            chosen = pd.concat([chosen, new.assign(position=float(len(chosen) + 1))])
        return chosen

    return queries.groupBy(search).applyInPandas(repair, schema)


def archive_weak(hypotheses: DataFrame, search: str, ceiling: int = 8, floor: float = 0.03) -> DataFrame:
    """status ACTIVE or ARCHIVED: the strongest `ceiling` with the floor at least stay active."""
    n = F.row_number().over(Window.partitionBy(search).orderBy(F.desc("posterior"), "id"))
    return hypotheses.withColumn("status", F.when((n <= ceiling) & (F.col("posterior") >= floor), "ACTIVE").otherwise("ARCHIVED"))


def normalised(hypotheses: DataFrame, search: str) -> DataFrame:
    """Active posteriors as shares of their sum, four digits."""
    active = F.col("status") == "ACTIVE"
    whole = F.sum(F.when(active, F.col("posterior"))).over(Window.partitionBy(search))
    return hypotheses.withColumn("posterior", F.when(active & (whole > 0), F.bround(F.col("posterior") / whole, 4)).otherwise(F.col("posterior")))


def contradicted(hypotheses: DataFrame, search: str) -> DataFrame:
    """Contradicted brands weigh 0.7, years 0.65; below 0.04 archived; 0.01 at least; then shares again."""
    weight = F.when(F.col("brand_contradicted"), 0.7).otherwise(1.0) * F.when(F.col("year_contradicted"), 0.65).otherwise(1.0)
    rows = hypotheses.withColumn("posterior", F.greatest(F.lit(0.01), F.col("posterior") * weight))
    return normalised(rows.withColumn("status", F.when(F.col("posterior") < 0.04, "ARCHIVED").otherwise(F.col("status"))), search)


def kept_ids(ranked: DataFrame, every: DataFrame, key: str, at: str, cap: int = 8) -> DataFrame:
    """Ranked ids first, then the others as found; each once, `cap` in all."""
    lanes = ranked.select(key, F.lit(0).alias("lane"), F.col(at).cast("long").alias("at")).unionByName(every.select(key, F.lit(1).alias("lane"), F.col(at).cast("long").alias("at")))
    first = lanes.groupBy(key).agg(F.min(F.struct("lane", "at")).alias("first"))
    return first.orderBy("first", key).limit(cap).select(key, F.col("first.lane").alias("lane"), F.col("first.at").alias("at"))


def promoted_aliases(evidence: DataFrame, alias: str) -> DataFrame:
    """Aliases backed by high authority (0.6 sure), by two families (0.4 sure), or by a verified improvement."""
    sums = evidence.groupBy(alias).agg(
        F.count_distinct(F.when(F.col("confidence") >= 0.4, F.col("family"))).alias("families"),
        F.max(F.when(F.col("high_authority") & (F.col("confidence") >= 0.6), 1).otherwise(0)).alias("authority"),
        F.max(F.when(F.col("improved") & F.col("verified"), 1).otherwise(0)).alias("improved"),
    )
    return sums.where((F.col("authority") == 1) | (F.col("families") >= 2) | (F.col("improved") == 1)).select(alias, "families", "authority", "improved")
