"""Retrieval, confusion, calibration and threshold metrics over the tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import index, metrics
from quarry.operators.cluster import written
from quarry.plans.registry import query, table

#: Every vector whose id can be divided by 20 against all other vectors.
PAIRS_SQL = """
  e AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
  pairs AS (SELECT a.vec_id AS query, b.vec_id AS item, a.label AS qlabel, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS score, a.label = b.label AS correct FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
"""

#: Every vector against all other vectors.
EVERY_PAIR_SQL = PAIRS_SQL.replace("a.vec_id % 20 = 0 AND ", "")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return e.where(F.col("vec_id") % 20 == 0), e


def counted_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correct, score (the middle of a tenth), n, total (of the scores): pairs of same and of different label, counted inside the blocks, at most 20 rows each; negatives left out."""

    def count(b: index.Block) -> pa.RecordBatch:
        keep = (b.q[:, None] != b.c[None, :]) & (b.cos >= 0)
        code = np.minimum(b.cos[keep] * 10, 9).astype(np.int64) * 2 + (b.q_more[0][:, None] == b.c_more[0][None, :])[keep]
        n, total = np.bincount(code), np.bincount(code, np.round(b.cos[keep] * 1e6)).astype(np.int64)
        some = np.nonzero(n)[0]
        return pa.RecordBatch.from_arrays([pa.array(some & 1 == 1), pa.array(some >> 1), pa.array(n[some]), pa.array(total[some])], names=["correct", "tenth", "n", "millionths"])

    asked, every = _asked(spark, sf_dir)
    counts = index.cosine_blocks(asked, every, "vec_id", "embedding", count, "correct boolean, tenth long, n long, millionths long", ("label",), ("label",)).groupBy("correct", "tenth").agg(F.sum("n").alias("n"), F.sum("millionths").alias("millionths"))
    return counts.select("correct", ((F.col("tenth") + 0.5) / 10).alias("score"), "n", (F.col("millionths") / 1e6).alias("total"))


def _ranked(b: index.Block) -> np.ndarray:
    """Cosines as the SQL orders them: one that is no number, as with a vector of zeros, stands before all others."""
    none = (b.q_norm == 0)[:, None] | (b.c_norm == 0)[None, :]
    return np.where(none | np.isnan(b.cos), np.inf, b.cos)


def first_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, qlabel, rank: for every vector, the place of the nearest other one of the same label, by score, then id; null if there is none.

    Two passes over blocks: each vector's best partner of its label, among that label's blocks alone, then how many of all
    others stand before it. No pair is kept. Cosines of single precision leave the few pairs that are then worked out in full;
    where those are many, as among copies, the whole strip is.
    """
    tops: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    no_item = np.iinfo(np.int64).max

    def best(b: index.Block) -> None:
        if b.name not in tops:
            tops[b.name] = b.q, np.full(len(b.q), -np.inf), np.full(len(b.q), no_item)
        _, score, item = tops[b.name]
        own = b.q[:, None] == b.c[None, :]
        if b.near is not None:
            near = np.where(own, -np.inf, b.near)
            i, j = index.reaching(near, np.maximum(near.max(axis=1) - 2 * b.slack, score - b.slack))
            other = ~own[i, j]
            i, j = i[other], j[other]
            if len(i) <= 2 * len(b.q) + near.size // 256:
                s, c = b.cos_of(i, j), b.c[j]
                order = np.lexsort((c, -s, i))
                i, at = np.unique(i[order], return_index=True)
                s, c = s[order][at], c[order][at]
                better = (s > score[i]) | ((s == score[i]) & (c < item[i]))
                score[i[better]], item[i[better]] = s[better], c[better]
                return
        cos = np.where(own, -np.inf, _ranked(b))
        s = cos.max(axis=1)
        c = np.where(~own & (cos == s[:, None]), b.c[None, :], no_item).min(axis=1)
        better = (c < no_item) & ((s > score) | ((s == score) & (c < item)))
        score[better], item[better] = s[better], c[better]

    def last() -> Iterator[pa.RecordBatch]:
        while tops:
            q, score, item = tops.popitem()[1]
            some = score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(q[some]), pa.array(score[some]), pa.array(item[some])], names=["query", "score", "item"])

    def ahead(b: index.Block) -> pa.RecordBatch | None:
        top, item = b.q_more
        before = None
        if b.near is not None:
            i, j = index.reaching(b.near, top - b.slack)
            sure = b.near[i, j] > (top + b.slack).astype(np.float32)[i]
            if len(i) - np.count_nonzero(sure) <= b.near.size // 256:
                other = b.q[i] != b.c[j]
                open_ = np.flatnonzero(other & ~sure)
                x, y = i[open_], j[open_]
                s, c = b.cos_of(x, y), b.c[y]
                sure[open_] = ((s > top[x]) | ((s == top[x]) & (c < item[x]))) & (c != item[x])
                before = np.bincount(i[sure & other], minlength=len(b.q))
        if before is None:
            cos, c = _ranked(b), b.c[None, :]
            stands = (cos > top[:, None]) | ((cos == top[:, None]) & (c < item[:, None]))
            before = (stands & (b.q[:, None] != c) & (c != item[:, None])).sum(axis=1)
        some = before > 0
        return pa.RecordBatch.from_arrays([pa.array(b.q[some]), pa.array(before[some])], names=["query", "before"]) if some.any() else None

    every = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    found = index.cosine_blocks(every, every, "vec_id", "embedding", best, "query long, score double, item long", last=last, within="label", near=True)
    first = written(found.groupBy("query").agg(F.max(F.struct("score", (-F.col("item")).alias("item"))).alias("b")).select(F.col("query").alias("vec_id"), F.col("b.score").alias("top"), (-F.col("b.item")).alias("item")))
    counts = index.cosine_blocks(every.join(first, "vec_id"), every, "vec_id", "embedding", ahead, "query long, before long", ("top", "item"), near=True)
    ranks = first.select(F.col("vec_id").alias("query")).join(counts.groupBy("query").agg(F.sum("before").alias("before")), "query", "left").select("query", (F.coalesce("before", F.lit(0)) + 1).alias("rank"))
    return every.select(F.col("vec_id").alias("query"), F.col("label").alias("qlabel")).join(ranks, "query", "left").select("query", "qlabel", "rank")


def counted_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calibration (whether a query's id can be divided by 40), correct, score (whole hundredths it reaches), n: at most 804 rows leave a block, as six digits are whole millionths."""

    def count(b: index.Block) -> pa.RecordBatch:
        keep = b.q[:, None] != b.c[None, :]
        reach = np.round(np.nan_to_num(b.cos, nan=1.0) * 1e6).astype(np.int32) // 10_000 + 101
        code = (reach * 2 + (b.q_more[0][:, None] == b.c_more[0][None, :])) * 2 + (b.q % 40 == 0)[:, None]
        n = np.bincount(code[keep])
        some = np.nonzero(n)[0]
        return pa.RecordBatch.from_arrays([pa.array(some & 1 == 1), pa.array(some >> 1 & 1 == 1), pa.array((some >> 2) - 101), pa.array(n[some])], names=["calibration", "correct", "hundredths", "n"])

    asked, every = _asked(spark, sf_dir)
    counts = index.cosine_blocks(asked, every, "vec_id", "embedding", count, "calibration boolean, correct boolean, hundredths long, n long", ("label",), ("label",)).groupBy("calibration", "correct", "hundredths").agg(F.sum("n").alias("n"))
    return counts.select("calibration", "correct", (F.col("hundredths") / 100).alias("score"), "n")


RANKS_SQL = f"{EVERY_PAIR_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS n FROM pairs), ranks AS (SELECT query, any_value(qlabel) AS qlabel, min(CASE WHEN correct THEN n END) AS rank FROM n GROUP BY 1)"


@query(f"WITH {RANKS_SQL} SELECT qlabel, count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INTEGER), 6) AS recall_1, round(avg((coalesce(rank, 99) <= 5)::INTEGER), 6) AS recall_5, round(avg((coalesce(rank, 99) <= 10)::INTEGER), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, count(*) FILTER (rank IS NULL) AS missing FROM ranks GROUP BY ROLLUP (qlabel)")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label and over all, each vector against all others."""
    return metrics.retrieval(first_correct(spark, sf_dir), "qlabel")


LABELLED_SQL = "p AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN length(text) > 400 THEN 'good' ELSE 'bad' END AS predicted FROM labels JOIN documents USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("n")), "doc_id")
    return j.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("n") > 400, "good").otherwise("bad").alias("predicted"))


@query(f"WITH {LABELLED_SQL}, g AS (SELECT * FROM (VALUES ('good'), ('bad'), ('unknown')) a(truth), (VALUES ('good'), ('bad'), ('unknown')) b(predicted)), c AS (SELECT truth, predicted, count(*) AS n FROM p GROUP BY ALL) SELECT g.truth, g.predicted, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.truth = c.truth AND g.predicted = c.predicted")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense over the labels."""
    return metrics.confusion(_labelled(spark, sf_dir), "truth", "predicted", ["good", "bad", "unknown"])


@query(f"WITH {LABELLED_SQL}, l(label) AS (VALUES ('good'), ('bad'), ('unknown')), s AS (SELECT label, count(*) FILTER (truth = label AND predicted = label) AS hit, count(*) FILTER (predicted = label) AS pred, count(*) FILTER (truth = label) AS t FROM l, p GROUP BY 1) SELECT label, round(hit / nullif(pred, 0), 6) AS precision, round(hit / nullif(t, 0), 6) AS recall, t AS support FROM s")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """null where the denominator is 0."""
    return metrics.precision_recall(_labelled(spark, sf_dir), "truth", "predicted", ["good", "bad", "unknown"])


@query(f"WITH {PAIRS_SQL}, b AS (SELECT least(floor(score * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(correct::INTEGER), 6) AS share FROM pairs WHERE score >= 0 GROUP BY 1) SELECT r.bin::INTEGER AS bin, coalesce(n, 0) AS n, mean_score, share FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ten bins, the last closed, empty ones kept."""
    return metrics.calibration_bins(counted_bins(spark, sf_dir), "score", "correct", weight="n", total="total")


SWEEP_SQL = f"{PAIRS_SQL}, t AS (SELECT unnest(range(40, 100))::INTEGER AS threshold), s AS (SELECT threshold, round(count(*) FILTER (correct AND round(score * 100, 9) >= threshold) / nullif(count(*) FILTER (correct), 0), 6) AS tpr, round(count(*) FILTER (NOT correct AND round(score * 100, 9) >= threshold) / nullif(count(*) FILTER (NOT correct), 0), 6) AS fpr FROM t, pairs GROUP BY 1)"


@query(f"WITH {SWEEP_SQL} SELECT * FROM s")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sixty thresholds from one pass over the pairs."""
    return metrics.threshold_sweep(counted_reach(spark, sf_dir), "score", "correct", weight="n")


@query(f"WITH {SWEEP_SQL} SELECT * FROM s WHERE fpr <= 0.05 ORDER BY tpr DESC, threshold LIMIT 1")
def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, Q7."""
    return metrics.choose_threshold(threshold_sweep(spark, sf_dir))


def _two_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, item, score, n: the two nearest other vectors of each query."""
    asked, every = _asked(spark, sf_dir)
    hits = index.vector_search(asked, every, "vec_id", "embedding", limit=3, least=-2.0).where(F.col("query_id") != F.col("listing_key"))
    w = Window.partitionBy("query_id").orderBy(F.desc("descriptor_score"), "listing_key")
    return hits.select(F.col("query_id").alias("query"), F.col("listing_key").alias("item"), F.col("descriptor_score").alias("score"), F.row_number().over(w).alias("n")).where(F.col("n") <= 2)


@query(f"WITH {PAIRS_SQL} SELECT query, max(score) AS best, arg_max(item, (score, -item)) AS item FROM pairs GROUP BY 1")
def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9, F4, H11."""
    return _two_best(spark, sf_dir).where(F.col("n") == 1).select("query", F.col("score").alias("best"), "item")


@query(f"WITH {PAIRS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS n FROM pairs) SELECT query, max(score) FILTER (n = 1) AS first, max(score) FILTER (n = 2) AS second, max(score) FILTER (n = 2) < 0.8 * max(score) FILTER (n = 1) AS distinct_match FROM n WHERE n <= 2 GROUP BY 1")
def ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match counts if the second best is far behind."""
    n, score = F.col("n"), F.col("score")
    one = _two_best(spark, sf_dir).groupBy("query").agg(F.max(F.when(n == 1, score)).alias("first"), F.max(F.when(n == 2, score)).alias("second"))
    return one.withColumn("distinct_match", F.col("second") < 0.8 * F.col("first"))


VERDICT_SQL = f"""WITH {PAIRS_SQL}, side AS (SELECT *, CASE WHEN query % 40 = 0 THEN 'calibration' ELSE 'held_out' END AS split FROM pairs),
  t AS (SELECT unnest(range(40, 100))::INTEGER AS threshold),
  s AS (SELECT split, threshold, round(count(*) FILTER (correct AND round(score * 100, 9) >= threshold) / nullif(count(*) FILTER (correct), 0), 6) AS tpr, round(count(*) FILTER (NOT correct AND round(score * 100, 9) >= threshold) / nullif(count(*) FILTER (NOT correct), 0), 6) AS fpr FROM t, side GROUP BY ALL),
  c AS (SELECT * FROM s WHERE split = 'calibration' AND fpr <= 0.05 ORDER BY tpr DESC, threshold LIMIT 1)
  SELECT c.threshold, c.tpr AS calibration_tpr, c.fpr AS calibration_fpr, h.tpr AS held_tpr, h.fpr AS held_fpr, h.fpr <= 0.05 AS holds FROM c JOIN s h ON h.split = 'held_out' AND h.threshold = c.threshold"""


@query(VERDICT_SQL)
def threshold_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: the threshold chosen on one half of the queries, judged on the other."""
    counts = counted_reach(spark, sf_dir)
    fitted = metrics.choose_threshold(metrics.threshold_sweep(counts.where("calibration"), "score", "correct", weight="n"))
    held = metrics.threshold_sweep(counts.where(~F.col("calibration")), "score", "correct", weight="n").select("threshold", F.col("tpr").alias("held_tpr"), F.col("fpr").alias("held_fpr"))
    return fitted.withColumnsRenamed({"tpr": "calibration_tpr", "fpr": "calibration_fpr"}).join(held, "threshold").withColumn("holds", F.col("held_fpr") <= 0.05)
