"""Line deduplication with levelled sorted runs of line hashes, in DataFrame operations only.

Documents arrive in batches of rising doc_id. The runs hold the 128-bit hashes of all line keys met so far; each run
is a table bucketed and sorted by hash, so that a batch is shuffled once and merged with every run in turn. A batch's
keys that are in no run form a new run of level 0; when a level holds `fanout` runs they are merged into one run of the
next level.

Defined results: null or empty text is one empty line. A row without doc_id keeps all its lines and owns none. Rows
that repeat a doc_id count as one document. Columns other than those asked for are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import SPACE, Stored, ascii_lower, carried, delete_path, shared_dir, stored, whole_text

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


class LineRuns:
    """The levelled runs. `flag` is the merge join with all of them, `add` appends a run and compacts full levels.

    A run is an external table: its files lie in the shared folder, whatever the warehouse setting is.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[str]:
        return [t for level in sorted(self.levels, reverse=True) for t in self.levels[level]]

    def flag(self, keys: DataFrame) -> DataFrame:
        """`keys` with the column seen: whether some run holds the hash. One merge join for each run."""
        out = keys.withColumn("seen", F.lit(False))
        for name in self.runs():
            run = self.spark.table(name).withColumn("hit", F.lit(True))
            out = out.join(run, HASH, "left").withColumn("seen", F.col("seen") | F.coalesce("hit", F.lit(False))).drop("hit")
        return out

    def _write(self, hashes: DataFrame) -> str:
        name = f"quarry_run_{uuid.uuid4().hex}"
        hashes.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").option("path", self._path(name)).saveAsTable(name)
        return name

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}"

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, self._path(name))

    def add(self, hashes: DataFrame) -> None:
        self.levels.setdefault(0, []).append(self._write(hashes.select(*HASH)))
        level = 0
        while len(full := self.levels.get(level, [])) >= self.fanout:
            merged = self.spark.table(full[0])
            for name in full[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.levels.setdefault(level + 1, []).append(self._write(merged))
            self.levels[level] = []
            for name in full:
                self._drop(name)
            level += 1

    def close(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = {}


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("doc_id", "tag", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc_id", "tag", "pos")


def dropped_lines(docs: DataFrame, runs: LineRuns, min_chars: int = 10) -> DataFrame:
    """One batch: the lines to drop as (doc_id, tag, pos); the batch's new keys are added to the runs.

    `docs` has doc_id and text; all its ids are above those of the batches before.
    """
    lines = Stored(_lines(docs, min_chars), "lines")
    keys = lines.df.groupBy(*HASH).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    flagged = Stored(runs.flag(keys), "keys")
    runs.add(flagged.df.where(~F.col("seen")))
    shared = flagged.df.where(F.col("seen") | (F.col("last") > F.col("owner"))).select(*HASH, "owner", "seen")
    drops = lines.df.join(shared, HASH).where(F.col("seen") | (F.col("doc_id") > F.col("owner"))).select("doc_id", "tag", "pos")
    out = stored(drops, "drops")
    lines.drop()
    flagged.drop()
    return out


def _without(lines: Column, gone: Column) -> Column:
    """`lines` without the places in `gone`, ascending: the stretches between them, each copied once.

    `lines` has to be a bound variable; an expression would be worked out again for every stretch.
    """
    before, after = F.array_insert(gone, 1, F.lit(-1)), F.array_append(gone, F.size(lines))
    stretches = F.zip_with(before, after, lambda a, b: F.struct((a + 2).alias("first"), (b - a - 1).alias("n")))
    return F.flatten(F.transform(stretches, lambda x: F.slice(lines, x["first"], x["n"])))


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = (), min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Each row of docs(doc_id, text, ...) as doc_id, text (lines kept), n_lines, n_dropped and the columns in `keep`.

    A line whose key has `min_chars` code points or more stays only in the smallest doc_id that holds it.
    """
    spark = docs.sparkSession
    own = ["doc_id", "text", "n_lines", "n_dropped"]
    base = docs.select("doc_id", whole_text("text").alias("text"), *carried(docs, keep, own))
    ids = base.select("doc_id").where(F.col("doc_id").isNotNull())
    cuts = ids.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    edges = [None, *sorted(set(cuts or [])), None]
    runs, drops = LineRuns(spark, fanout), None
    try:
        for low, high in zip(edges, edges[1:], strict=False):
            part = base.where(F.col("doc_id").isNotNull())
            part = part if low is None else part.where(F.col("doc_id") > low)
            part = part if high is None else part.where(F.col("doc_id") <= high)
            found = dropped_lines(part.select("doc_id", "text"), runs, min_chars)
            drops = found if drops is None else drops.unionByName(found)
    finally:
        runs.close()
    gone = drops.distinct().groupBy("doc_id", "tag").agg(F.collect_list("pos").alias("gone"))
    lined = base.withColumn("tag", F.xxhash64("text")).join(gone, ["doc_id", "tag"], "left")
    lines = F.split("text", "\n")
    kept = F.get(F.transform(F.array(lines), lambda own: F.array_join(_without(own, F.sort_array("gone")), "\n")), 0)
    return lined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), *carried(docs, keep, own))
