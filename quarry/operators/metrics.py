"""Retrieval, confusion, calibration and threshold metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def retrieval(ranks: DataFrame, group: str) -> DataFrame:
    """By group and over all (group null): n, recall at 1, 5, 10, MRR, missing. A null rank is a miss."""
    r = F.col("rank")
    at = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6)
    return ranks.rollup(group).agg(F.count(F.lit(1)).alias("n"), at(1).alias("recall_1"), at(5).alias("recall_5"), at(10).alias("recall_10"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"), F.count_if(r.isNull()).alias("missing"))


def ranks_of(pairs: DataFrame, query: str, item: str, score: str, correct: str) -> DataFrame:
    """(query, rank): place of the first correct item, by score, then item; null if there is none."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    placed = pairs.withColumn("_n", F.row_number().over(w))
    return placed.groupBy(query).agg(F.min(F.when(F.col(correct), F.col("_n"))).alias("rank"))


def confusion(pairs: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """A row for each pair of labels, also those without cases."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"{truth} string, {predicted} string")
    counts = pairs.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [truth, predicted], "left").select(truth, predicted, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def precision_recall(pairs: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """By label; null where nothing was predicted or nothing is true."""
    t, p = F.col(truth), F.col(predicted)
    sums = pairs.agg(*(e.alias(f"{k}_{i}") for i, x in enumerate(labels) for k, e in (("hit", F.count_if((t == x) & (p == x))), ("pred", F.count_if(p == x)), ("true", F.count_if(t == x)))))
    rows = F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"hit_{i}").alias("hit"), F.col(f"pred_{i}").alias("pred"), F.col(f"true_{i}").alias("truth")) for i, x in enumerate(labels)))
    each = sums.select(F.explode(rows).alias("r")).select("r.*")
    return each.select("label", F.round(F.try_divide("hit", "pred"), 6).alias("precision"), F.round(F.try_divide("hit", "truth"), 6).alias("recall"), F.col("truth").alias("support"))


def calibration_bins(pairs: DataFrame, score: str, positive: str, width: float = 0.1, weight: str | None = None, total: str | None = None) -> DataFrame:
    """bin, n, mean_score, share: bins [lo, hi), the last closed; empty bins stay with null means. A row counts `weight` times, with scores of `total` in sum where `score` only names its bin."""
    k = F.col(weight) if weight else F.lit(1)
    all_of = F.col(total) if total else F.col(score) * k
    n = round(1 / width)
    at = F.least(F.floor(F.col(score) * n), F.lit(n - 1)).cast("int")
    bins = pairs.where(F.col(score).isNotNull()).groupBy(at.alias("bin")).agg(F.sum(k).alias("n"), F.round(F.sum(all_of) / F.sum(k), 6).alias("mean_score"), F.round(F.sum(F.when(F.col(positive), k).otherwise(0)) / F.sum(k), 6).alias("share"))
    grid = pairs.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return grid.join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_score", "share")


def threshold_sweep(pairs: DataFrame, score: str, positive: str, low: int = 40, high: int = 99, weight: str | None = None) -> DataFrame:
    """threshold in hundredths, tpr, fpr. Scores are counted by hundredth once; a running sum over at most 102 rows follows."""
    s, p, k = F.col(score), F.col(positive), F.col(weight) if weight else F.lit(1)
    # the highest threshold a score reaches; rounding first keeps 0.57 * 100 from falling below 57
    reach = F.greatest(F.lit(-1), F.least(F.lit(100), F.floor(F.round(s * 100, 9)))).cast("int")
    counts = pairs.where(s.isNotNull()).groupBy(reach.alias("reach")).agg(F.sum(F.when(p, k).otherwise(0)).alias("pos"), F.sum(F.when(p, 0).otherwise(k)).alias("neg"))
    grid = pairs.sparkSession.range(-1, 101).select(F.col("id").cast("int").alias("reach"))
    w = Window.orderBy(F.desc("reach")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = grid.join(F.broadcast(counts), "reach", "left").na.fill(0, ["pos", "neg"]).select("reach", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(Window.partitionBy(F.lit(1))).alias("all_pos"), F.sum("neg").over(Window.partitionBy(F.lit(1))).alias("all_neg"))
    return run.where(F.col("reach").between(low, high)).select(F.col("reach").alias("threshold"), F.round(F.try_divide("tp", "all_pos"), 6).alias("tpr"), F.round(F.try_divide("fp", "all_neg"), 6).alias("fpr"))


def choose_threshold(swept: DataFrame, most_fpr: float = 0.05) -> DataFrame:
    """Largest tpr, then lowest threshold, among those with few enough false positives."""
    return swept.where(F.col("fpr") <= most_fpr).orderBy(F.desc("tpr"), "threshold").limit(1)


def false_real(pairs: DataFrame, item: str, truth: str, predicted: str) -> DataFrame:
    """One row: how many were published as real that are not, over all and over those not real, and the ids in order. The ids of errors are few or the engine is not in use."""
    wrong = (F.col(predicted) == "real") & (F.col(truth) != "real")
    sums = pairs.agg(F.count_if(wrong).alias("count"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) != "real").alias("n_not_real"), F.sort_array(F.collect_list(F.when(wrong, F.col(item)))).alias("ids"))
    return sums.select("count", "n", "n_not_real", F.round(F.try_divide("count", "n"), 6).alias("rate_among_all"), F.round(F.try_divide("count", "n_not_real"), 6).alias("rate_among_not_real"), "ids")


def operational(runs: DataFrame) -> DataFrame:
    """runs(campaign, seconds, images, fetches, cache_hits) as one row: totals, seconds a campaign, images a second, share of reads from a cache."""
    sums = runs.agg(F.count_distinct("campaign").alias("campaigns"), F.sum("seconds").alias("seconds"), F.sum("images").alias("images"), F.sum("fetches").alias("fetches"), F.sum("cache_hits").alias("hits"))
    part = lambda a, b: F.round(F.try_divide(a, b), 6)
    return sums.select("campaigns", F.round("seconds", 6).alias("seconds"), "images", "fetches", part(F.col("seconds"), F.col("campaigns")).alias("seconds_per_campaign"), part(F.col("images"), F.col("seconds")).alias("images_per_second"), part(F.col("hits"), F.col("hits") + F.col("fetches")).alias("cache_hit_rate"))


def assigned_split(items: DataFrame, handle: str, target: str, first: int = 5) -> DataFrame:
    """split of each handle: the target is held out, the first others by name calibrate, the rest are held out."""
    few = items.where(F.col(handle) != target).select(handle).distinct().orderBy(handle).limit(first).withColumn("_c", F.lit(True))
    return items.join(F.broadcast(few), handle, "left").withColumn("split", F.when(F.col("_c"), "calibration").otherwise("held_out")).drop("_c")  # `first` rows


def calibrated(rows: DataFrame, raw: str, bins: list[tuple[float, float, float, float]] | None) -> DataFrame:
    """cal_mean, spread, calibrated from bins (lo, hi, cal_mean, spread), lo inclusive; without a table or a bin the raw mean and a wide spread."""
    x, out = F.col(raw), F.struct(F.col(raw).cast("double").alias("cal_mean"), F.lit(0.22 if bins is None else 0.16).alias("spread"), F.lit(False).alias("calibrated"))
    for lo, hi, mean, spread in bins or []:
        out = F.when((x >= lo) & (x < hi), F.struct(F.lit(mean).alias("cal_mean"), F.lit(spread).alias("spread"), F.lit(True).alias("calibrated"))).otherwise(out)
    return rows.select("*", out.alias("_c")).select("*", "_c.cal_mean", "_c.spread", "_c.calibrated").drop("_c")


def empty_side(spark: SparkSession, a: DataFrame, b: DataFrame) -> bool:
    """Whether a leakage check would compare nothing, which is an error and no pass."""
    return a.limit(1).count() == 0 or b.limit(1).count() == 0
