"""Sharding over fixed virtual slots, in DataFrame operations only.

A record's virtual slot is a hash of its id and text over a fixed number of slots. Bytes and rows are summed by slot,
the slots are dealt to shards so that bytes come out near equal, and the map is stored under a version; rows are placed
from the map as it is read back. Rebalancing edits the map: only slots that have to move change their shard. The map
has `SLOTS` rows at any input size.

Defined results: null text has no bytes; null ids are records as any other; equal rows are dealt evenly over slots from
the one their hash names, so that a row repeated without end still leaves shards near equal; an empty table gives an
empty result. Columns other than the id are left out.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.frames import shared_dir, stored, whole_text

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, shards int, rows long, bytes long"


def records(docs: DataFrame, slots: int = SLOTS, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, tag, vslot and how many equal records lie there.

    Equal rows meet before any shuffle; their count is then split evenly over as many slots as there are copies, all
    slots at most.
    """
    text = whole_text("text")
    rows = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tag"))
    rows = rows.groupBy("doc_id", "size", "text_crc32", "tag").agg(F.count(F.lit(1)).alias("n"))
    parts = F.least("n", F.lit(slots))
    rows = rows.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    copies = F.floor(F.col("n") / F.col("parts")) + F.when(F.col("part") < F.col("n") % F.col("parts"), 1).otherwise(0)
    vslot = F.pmod(F.xxhash64("doc_id", "tag") % slots + F.col("part"), F.lit(slots)).cast("int")
    return rows.select("doc_id", "size", "text_crc32", "tag", copies.alias("copies"), vslot.alias("vslot"))


def slot_totals(recs: DataFrame) -> DataFrame:
    return recs.groupBy("vslot").agg(F.sum("copies").alias("rows"), F.sum(F.col("copies") * F.col("size")).alias("bytes"))


def deal(totals: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS, old: dict[int, int] | None = None, slack: float = 0.01) -> dict[int, int]:
    """Slot to shard, near equal in bytes: largest slot first to the lightest shard.

    With `old`, slots stay where they are while their shard holds at most (1 + slack) times the mean; the others move.
    """
    size = {s: totals.get(s, (0, 0))[1] for s in range(slots)}
    order = sorted(size, key=lambda s: (-size[s], s))
    load, out = [0] * shards, {}
    limit = (1 + slack) * sum(size.values()) / shards
    for s in order if old else ():
        home = old.get(s, -1)
        if 0 <= home < shards and load[home] + size[s] <= limit:
            out[s] = home
            load[home] += size[s]
    heap = [(b, i) for i, b in enumerate(load)]
    heapq.heapify(heap)
    empty = 0
    for s in order:
        if s in out:
            continue
        if not size[s]:  # nothing to weigh: in turn
            out[s], empty = old.get(s, empty % shards) if old and old.get(s, shards) < shards else empty % shards, empty + 1
            continue
        b, i = heapq.heappop(heap)
        out[s] = i
        heapq.heappush(heap, (b + size[s], i))
    return out


class SlotMap:
    """A slot-to-shard map under a version number."""

    def __init__(self, shard: dict[int, int], shards: int, version: int = 0, totals: dict[int, tuple[int, int]] | None = None):
        self.shard, self.shards, self.version, self.totals = shard, shards, version, totals or {}

    @classmethod
    def build(cls, totals: DataFrame, shards: int, slots: int = SLOTS) -> SlotMap:
        found = {r[0]: (r[1], r[2]) for r in totals.select("vslot", "rows", "bytes").collect()}  # at most `slots` rows
        return cls(deal(found, shards, slots), shards, 0, found)

    def rebalanced(self, totals: DataFrame, shards: int) -> SlotMap:
        """The next version, for new totals or another number of shards."""
        found = {r[0]: (r[1], r[2]) for r in totals.select("vslot", "rows", "bytes").collect()}
        return SlotMap(deal(found, shards, len(self.shard), self.shard), shards, self.version + 1, found)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, s, h, self.shards, *self.totals.get(s, (0, 0))) for s, h in sorted(self.shard.items())]
        return spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def stored_frame(spark: SparkSession, path: str, version: int) -> DataFrame:
        return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = cls.stored_frame(spark, path, version).collect()
        return cls({r["slot"]: r["shard"] for r in rows}, rows[0]["shards"], version, {r["slot"]: (r["rows"], r["bytes"]) for r in rows if r["rows"]})


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, gapless from 0) and vslot, one row per row of docs.

    The map is written below `maps` (default: a new folder beside other intermediate tables) as version 0. Places come
    from running counts inside each virtual slot plus the slot's start in its shard, so that no task sees more than a
    virtual slot.
    """
    spark = docs.sparkSession
    maps = maps or f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}"
    recs = stored(records(docs, slots), "records")
    SlotMap.build(slot_totals(recs), shards, slots).save(spark, maps)
    stored_map = SlotMap.stored_frame(spark, maps, 0)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # `slots` rows in all
    starts = stored_map.select(F.col("slot").alias("vslot"), "shard", "rows").withColumn("first", F.sum("rows").over(before) - F.col("rows"))
    placed = recs.join(F.broadcast(starts.drop("rows")), "vslot")  # `slots` rows
    w = Window.partitionBy("vslot").orderBy("doc_id", "tag", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("place", F.col("first") + F.sum("copies").over(w) - F.col("copies"))
    placed = placed.withColumn("slot", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("copies") - 1)))
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "vslot")
