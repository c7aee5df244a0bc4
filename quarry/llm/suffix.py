"""Substring deduplication by names of strings, doubled within buffers; exact but for collisions of two 64-bit hashes.

Strings are given names (two hashes of 64 bits) instead of ranks from a distributed sort: the name of 2h bytes at p is
made from the names of h bytes at p and p + h, so names are equal where the bytes are, and where names are equal the
bytes are taken to be. The README says why ranks are not sorted in Spark. Positions leave as soon as their name is unique:

1. Names of `gram` bytes. A window of `length` bytes is represented by the gram in it whose name is smallest (the
   leftmost of equals), its anchor; equal windows have equal anchors at the same place inside. Spark counts the anchors'
   names; where one occurs once, no window it represents repeats, and all of them leave.
2. Windows with one anchor form a block. Blocks are named over all their bytes; where a gram and a block name occur
   together more than once, each of the block's windows repeats, and it is settled.
3. For grams with more than one block name, the windows of one block of each name get the name of all `length` bytes,
   paired from those of shorter ones, and Spark counts pairs of gram name and window name.

Each round moves fixed-size rows, counted before they are shuffled where equal ones meet, so a passage that a third of
all documents share is no heavier than any other.

Defined results: null text is empty; texts shorter than `length` lose nothing. Rows that repeat an id, or have none,
are documents of their own, told apart by their text. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import Stored, map_rows, small_batches, stored, whole_text

BUFFER = 1 << 17  # bytes named at once
_PLACE = np.uint64((1 << 18) - 1)


def _spread(seed: int) -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Names:
    """Names of substrings of one buffer, doubled from single bytes."""

    def __init__(self, data: np.ndarray, seed: int):
        self.one = _spread(seed)[data]
        self.left, self.right = np.uint64(0x9FB21C651E98DF25 + 2 * seed), np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
        self.power = {1: self.one}

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * self.left
        x ^= b
        x *= self.right
        x ^= x >> np.uint64(29)
        return x

    def of(self, length: int) -> np.ndarray:
        """At every place that has `length` bytes from it on."""
        h = max(self.power)
        while 2 * h <= length:
            now = self.power[h]
            self.power[2 * h] = self.pair(now[:-h], now[h:])
            h *= 2
        h = 1 << (length.bit_length() - 1)
        now = self.power[h]
        return now if h == length else self.pair(now[: len(self.one) - length + 1], now[length - h :])


def _leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of the least one, the leftmost of equals as far as 46 bits tell."""
    low = (x & ~_PLACE) | np.arange(len(x), dtype=np.uint64)
    h = 1
    while 2 * h <= width:
        low = np.minimum(low[:-h], low[h:])
        h *= 2
    if h < width:
        low = np.minimum(low[: len(x) - width + 1], low[width - h :])
    return (low & _PLACE).astype(np.int64)


def _segments(data: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a text with all its windows: each with its start, overlapping by length - 1."""
    step = BUFFER - length
    for s in range(0, max(1, len(data) - length + 1), step):
        yield s, data[s : s + step + length - 1]


class Anchors:
    """Blocks of many texts: arrays gram, block (names), text (number), low, high (first and last window start)."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.parts: list[tuple[int, int, bytes]] = []
        self.held = 0

    def add(self, text: int, data: bytes) -> None:
        if len(data) >= self.length:
            for s, piece in _segments(data, self.length):
                self.parts.append((text, s, piece))
                self.held += len(piece)

    def blocks(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The blocks of all that was added, a buffer at a time."""
        parts, self.parts, self.held = self.parts, [], 0
        while parts:
            size, n = 0, 0
            while n < len(parts) and (n == 0 or size + len(parts[n][2]) <= BUFFER):
                size += len(parts[n][2])
                n += 1
            yield self._buffer(parts[:n])
            parts = parts[n:]

    def _buffer(self, parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        size = np.array([len(p[2]) for p in parts])
        first = np.cumsum(size) - size
        windows = size - self.length + 1
        grams = Names(data, 1).of(self.gram)
        whole = Names(data, 2).of(self.length)
        anchor = _leftmost_least(grams, self.length - self.gram + 1)
        owner = np.repeat(np.arange(len(parts)), windows)
        start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
        a = anchor[start]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])
        at = np.nonzero(new)[0]
        end = np.append(at[1:], len(a)) - 1
        low, high, a, owner = start[at], start[end], a[at], owner[at]
        mix = Names(data[:0], 3)
        shape = ((a - low).astype(np.uint64) << np.uint64(32)) | (high - a + self.length).astype(np.uint64)
        block = mix.pair(mix.pair(whole[low], whole[high]), shape)
        shift = np.array([p[1] for p in parts])[owner] - first[owner]
        text = np.array([p[0] for p in parts])[owner]
        return grams[a].view(np.int64), block.view(np.int64), text, low + shift, high + shift


def _blocks(batches: Iterator[pa.RecordBatch], length: int, gram: int, named: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tag, data) to blocks: gram, block, or with `named` gram, block, doc_id, tag, low, high."""
    for b in batches:
        ids, tags = b.column(0), b.column(1)
        anchors, texts = Anchors(length, gram), b.column(2)

        def flush(anchors: Anchors = anchors, ids: pa.Array = ids, tags: pa.Array = tags) -> Iterator[pa.RecordBatch]:
            for grams, block, text, low, high in anchors.blocks():
                if named:
                    take = pa.array(text)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(block), ids.take(take), tags.take(take), pa.array(low), pa.array(high)], names=["gram", "block", "doc_id", "tag", "low", "high"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(block)], names=["gram", "block"])

        for k in range(b.num_rows):
            anchors.add(k, texts[k].as_py().encode())
            if anchors.held >= 4 * BUFFER:
                yield from flush()
        yield from flush()


def repeats(docs: DataFrame, length: int = 200, gram: int = 150) -> DataFrame:
    """doc_id, tag, low, high: runs of places where a string of `length` bytes starts that starts elsewhere too."""
    base = docs.select("doc_id", F.xxhash64(whole_text("text")).alias("tag"), whole_text("text").alias("data")).where(F.octet_length("data") >= length)
    place = ["doc_id", "tag", "low", "high"]
    small_batches(docs.sparkSession)
    counted = base.mapInArrow(lambda it: _blocks(it, length, gram, False), "gram long, block long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("a"), F.max("block").alias("b"))
    grams = Stored(counted.where(F.col("n") > 1).select("gram", (F.col("a") == F.col("b")).alias("settled")), "grams")
    named = base.mapInArrow(lambda it: _blocks(it, length, gram, True), "gram long, block long, doc_id long, tag long, low long, high long")
    # names are kept only where they are needed again
    open_only = lambda c: F.when(~F.col("settled"), F.col(c)).alias(c)
    left = Stored(named.join(grams.df, "gram").select("settled", open_only("gram"), open_only("block"), *place), "left")
    grams.drop()
    settled = left.df.where("settled").select(*place)
    mixed = left.df.where("NOT settled").drop("settled")
    each = Stored(mixed.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("one")), "blocks")
    copied = mixed.join(each.df.where(F.col("n") > 1).select("gram", "block"), ["gram", "block"]).select(*place)
    ones = each.df.select("gram", "one.*", (F.col("n") == 1).alias("single")).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("low", "high", "gram", "single")).alias("blocks"))
    texts = base.join(ones, base.doc_id.eqNullSafe(ones.doc_id) & (base.tag == ones.tag)).select(base.doc_id, base.tag, "data", *(F.col(f"blocks.{c}").alias(f"{c}s") for c in ("low", "high", "gram", "single")))
    # equal rows both give the windows of a block they share; such a block is not single, and a single window that meets it repeats
    windows = Stored(texts.mapInArrow(lambda it: _windows(it, length), "gram long, name long, single boolean, doc_id long, tag long, low long"), "windows")
    twice = windows.df.groupBy("gram", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("gram", "name")
    found = stored(windows.df.where("single").join(twice, ["gram", "name"]).select("doc_id", "tag", "low", F.col("low").alias("high")), "found")
    windows.drop()
    return settled.unionByName(copied).unionByName(found)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each text with its open blocks: the names of their windows."""
    for b in batches:
        for k in range(b.num_rows):
            doc_id, tag, text, lows, highs, grams, singles = (b.column(c)[k].as_py() for c in range(7))
            data = text.encode()
            order = np.argsort(lows, kind="stable")
            low, high, gram, single = np.array(lows)[order], np.array(highs)[order], np.array(grams, np.int64)[order], np.array(singles, bool)[order]
            at = 0
            while at < len(low):  # runs of blocks that fit a buffer
                end = at + 1
                while end < len(low) and high[end] + length - low[at] <= BUFFER and low[end] <= high[end - 1] + length:
                    end += 1
                piece = np.frombuffer(data[low[at] : high[end - 1] + length], np.uint8)
                names = Names(piece, 2).of(length)
                size = high[at:end] - low[at:end] + 1
                start = np.repeat(low[at:end] - np.cumsum(size) + size, size) + np.arange(size.sum())
                n = len(start)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(gram[at:end], size)), pa.array(names[start - low[at]].view(np.int64)), pa.array(np.repeat(single[at:end], size)), pa.array([doc_id] * n, pa.int64()), pa.array(np.full(n, tag, np.int64)), pa.array(start)], names=["gram", "name", "single", "doc_id", "tag", "low"])
                at = end


def runs_of(lows: list[int], highs: list[int], length: int) -> list[tuple[int, int]]:
    """Byte ranges [start, end) that the windows starting in the given runs cover, joined where they touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(lows, highs, strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e + length)
        else:
            out.append((s, e + length))
    return out


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 150) -> DataFrame:
    """doc_id, data (bytes kept), spans (removed ranges: start, end), n_bytes, one row per row of docs."""
    found = repeats(docs, length, gram).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("low", "high")).alias("runs"))  # rows that repeat give their runs once
    base = docs.select("doc_id", F.xxhash64(whole_text("text")).alias("tag"), whole_text("text").alias("data"))
    joined = base.join(found, base.doc_id.eqNullSafe(found.doc_id) & (base.tag == found.tag), "left").select(base.doc_id, "data", F.col("runs.low").alias("lows"), F.col("runs.high").alias("highs"))

    def f(row: tuple) -> Iterator[tuple]:
        doc_id, text, lows, highs = row
        data = text.encode()
        spans = runs_of(lows or [], highs or [], length)
        kept, at = [], 0
        for s, e in spans:
            kept.append(data[at:s])
            at = e
        kept.append(data[at:])
        yield doc_id, b"".join(kept), [{"start": s, "end": e} for s, e in spans], len(data)

    return map_rows(joined, "doc_id long, data binary, spans array<struct<start: long, end: long>>, n_bytes long", lambda: f, weigh=1)


def removal_digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"))


