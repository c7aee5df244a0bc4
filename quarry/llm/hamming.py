"""All links between 64-bit fingerprints at a small Hamming distance, through Gray-order hierarchical indexes.

The 64 bits are cut into `fields` fields. Two fingerprints that differ in at most r bits agree in at least
fields - r of them, so for every choice of that many fields there is one index, and fingerprints are compared below
one top node (equal chosen fields) only. Below it they are sorted by Gray rank; runs of neighbours are leaves, whose
shared bits are factored into a mask and a value, and runs of nodes form upper nodes in the same way. Two nodes are
compared from the top: differences on bits that both share add up on the way down, and a pair of whole groups is left
as soon as the sum passes r. Pairs of groups already linked to one component are left too, so that a dense group costs
no work for all its pairs. A top node with very many fingerprints is cut along the Gray order into as many chunks as
its size asks for, and each pair of chunks that may hold a link is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import Stored
from quarry.llm.ranges import with_running_start

LEAF, FAN = 32, 16
KEY = ["choice", "field"]


def _find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = parent[i]
    while True:
        n = parent[r]
        if np.array_equal(n, r):
            return r
        r = n


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = _find(parent, i), _find(parent, j)
        low, high = np.minimum(a, b), np.maximum(a, b)
        differ = low != high
        if not differ.any():
            return
        low, high, i, j = low[differ], high[differ], i[differ], j[differ]
        np.minimum.at(parent, high, low)


class GrayIndex:
    """Fingerprints in Gray order with their nodes; level 0 are leaves of `LEAF`, each level above groups `FAN`."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(0, len(prints), LEAF)
        same, some = np.bitwise_and.reduceat(prints, at), np.bitwise_or.reduceat(prints, at)
        while True:
            self.levels.append((~(same ^ some), same))
            if len(same) == 1:
                break
            at = np.arange(0, len(same), FAN)
            same, some = np.bitwise_and.reduceat(same, at), np.bitwise_or.reduceat(some, at)

    def uniform(self, root: np.ndarray) -> list[np.ndarray]:
        """For each node the root that all its fingerprints share, or -1."""
        at = np.arange(0, len(root), LEAF)
        low, high, out = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at), []
        for k in range(len(self.levels)):
            out.append(np.where(low == high, low, -1))
            if k + 1 < len(self.levels):
                at = np.arange(0, len(low), FAN)
                low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        return out


def _leaf_links(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked fingerprints, for pairs of leaves; past the end a leaf has none."""
    step = np.arange(LEAF)
    i, j = a[:, None] * LEAF + step, b[:, None] * LEAF + step
    u, v = x[np.minimum(i, len(x) - 1)], y[np.minimum(j, len(y) - 1)]
    near = np.bitwise_count(u[:, :, None] ^ v[:, None, :]) <= radius
    near &= (i < len(x))[:, :, None] & (j < len(y))[:, None, :]
    p, s, t = np.nonzero(near)
    return i[p, s], j[p, t]


def linked(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links (as fingerprints) inside x, or between x and y, both in Gray order without repeats."""
    own = y is None
    left, right = GrayIndex(x), GrayIndex(x if own else y)
    y = x if own else y
    shift = 0 if own else len(x)
    parent = np.arange(len(x) + (0 if own else len(y)))
    top = max(len(left.levels), len(right.levels))
    for index in (left, right):
        while len(index.levels) < top:
            index.levels.append(index.levels[-1])
    if own:  # neighbours in Gray order first: dense groups join up at once
        n = -(-len(x) // LEAF)
        for k in range(0, n, 256):
            a = np.arange(k, min(n, k + 256))
            for b in (a, np.minimum(a + 1, n - 1)):
                _unite(parent, *_leaf_links(x, x, a, b, radius))
    roots = _find(parent, np.arange(len(parent)))
    marks = left.uniform(roots[: len(x)]), right.uniform(roots[shift:])
    zero = np.zeros(1, np.int64)
    stack, since = [(top - 1, zero, zero, zero, np.zeros(1, np.uint64))], 0
    while stack:
        level, a, b, acc, seen = stack.pop()
        (ml, vl), (mr, vr) = left.levels[level], right.levels[level]
        shared = ml[a] & mr[b]
        acc = acc + np.bitwise_count((vl[a] ^ vr[b]) & shared & ~seen)
        done = (marks[0][level][a] >= 0) & (marks[0][level][a] == marks[1][level][b])
        go = (acc <= radius) & ~done
        a, b, acc, seen = a[go], b[go], acc[go], shared[go]
        if not len(a):
            continue
        if level == 0:
            i, j = _leaf_links(x, y, a, b, radius)
            j = j + shift
            fresh = roots[i] != roots[j]
            if fresh.any():
                _unite(parent, i[fresh], j[fresh])
                since += 1
                if since >= 4:
                    since, roots = 0, _find(parent, np.arange(len(parent)))
                    marks = left.uniform(roots[: len(x)]), right.uniform(roots[shift:])
            continue
        nl, nr = len(left.levels[level - 1][0]), len(right.levels[level - 1][0])
        if nl == len(ml) and nr == len(mr):  # padded level
            stack.append((level - 1, a, b, acc, seen))
            continue
        fl, fr = (1 if nl == len(ml) else FAN), (1 if nr == len(mr) else FAN)
        ca = (a[:, None, None] * fl + np.arange(fl)[None, :, None]) + np.zeros((1, 1, fr), np.int64)
        cb = (b[:, None, None] * fr + np.arange(fr)[None, None, :]) + np.zeros((1, fl, 1), np.int64)
        ok = (ca < nl) & (cb < nr)
        if own:
            ok &= ca <= cb
        ok = ok.reshape(-1)
        ca, cb = ca.reshape(-1)[ok], cb.reshape(-1)[ok]
        acc, seen = np.repeat(acc, fl * fr)[ok], np.repeat(seen, fl * fr)[ok]
        most = 256 if level == 1 else 1024
        for k in range(0, len(ca), most):
            stack.append((level - 1, ca[k : k + most], cb[k : k + most], acc[k : k + most], seen[k : k + most]))
    roots = _find(parent, np.arange(len(parent)))
    moved = np.nonzero(roots != np.arange(len(parent)))[0]
    both = x if own else np.concatenate([x, y])
    return both[moved], both[roots[moved]]


def gray_rank(c: Column) -> Column:
    """Place of a 64-bit code in Gray order, as a long that sorts like the unsigned rank."""
    for s in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, s))
    return c.bitwiseXOR(F.lit(-(2**63)))


def field_masks(radius: int, fields: int) -> list[tuple[int, int]]:
    """(mask of the chosen fields, first bit of the first of them from the top) for each choice; bit 0 is the top."""
    cuts = [64 * i // fields for i in range(fields + 1)]
    part = [sum(1 << (63 - b) for b in range(cuts[i], cuts[i + 1])) for i in range(fields)]
    return [(sum(part[i] for i in own), cuts[own[0]]) for own in combinations(range(fields), fields - radius)]


def fields_for(n: int, radius: int, group: int = 2048) -> int:
    """Fewest fields at which n even fingerprints leave about `group` below each top node; at most radius + 4."""
    fields = radius + 1
    while fields < radius + 4 and n / 2 ** min(m.bit_count() for m, _ in field_masks(radius, fields)) > group:
        fields += 1
    return fields


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (choice, field, low, high, side, rank): the links of each task in turn."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints, side = rows["print"], rows["side"]
        if len(rows) < 2:
            return prints[:0], prints[:0]
        if rows["low"][0] == rows["high"][0]:
            return linked(prints, None, radius)
        x, y = prints[side == 0], prints[side == 1]
        return linked(x, y, radius) if len(x) and len(y) else (prints[:0], prints[:0])

    def out(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(z).view(np.int64) for z in zip(*pairs, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    kind = np.dtype([("choice", "i4"), ("field", "i8"), ("low", "i8"), ("high", "i8"), ("side", "i4"), ("print", "u8")])

    def groups(rows: np.ndarray) -> np.ndarray:
        change = np.zeros(len(rows), bool)
        change[1:] = (rows["choice"][1:] != rows["choice"][:-1]) | (rows["field"][1:] != rows["field"][:-1]) | (rows["low"][1:] != rows["low"][:-1]) | (rows["high"][1:] != rows["high"][:-1])
        return np.concatenate([[0], np.nonzero(change)[0], [len(rows)]])

    for b in batches:
        if not b.num_rows:
            continue
        rows = np.empty(b.num_rows, kind)
        for name in ("choice", "field", "low", "high", "side"):
            rows[name] = b.column(name).to_numpy()
        rows["print"] = b.column("print").to_numpy().view(np.uint64)
        rows = np.concatenate([*held, rows])
        at = groups(rows)
        pairs = [links(rows[s:e]) for s, e in zip(at[:-2], at[1:-1], strict=True)]
        held = [rows[at[-2] :]]
        if pairs:
            yield out(pairs)
    if held:
        yield out([links(held[0])])


def _cut_rows(rows: DataFrame, radius: int, cut: int) -> DataFrame:
    """Rows of large top nodes by pair of chunks (low, high). A chunk is a run of at most `cut` rows in Gray order.

    A chunk is a node as those of `GrayIndex` are: pairs of chunks whose shared bits differ in more than `radius` places
    are left before any row is copied.
    """
    numbered = with_running_start(rows.withColumn("one", F.lit(1).cast("long")), [*KEY, "rank"], "one", "place")
    placed = Stored(numbered.select(*KEY, "print", "rank", F.floor(F.col("place") / cut).alias("chunk")), "chunks").df
    nodes = placed.groupBy(*KEY, "chunk").agg(F.bit_and("print").alias("same"), F.bit_or("print").alias("some"))
    nodes = Stored(nodes.select(*KEY, "chunk", "same", F.bitwise_not(F.col("same").bitwiseXOR(F.col("some"))).alias("mask")), "nodes").df
    left, right = (nodes.select(*KEY, *(F.col(c).alias(c + end) for c in ("chunk", "same", "mask"))) for end in ("_l", "_r"))
    apart = F.bit_count(F.col("same_l").bitwiseXOR(F.col("same_r")).bitwiseAND(F.col("mask_l")).bitwiseAND(F.col("mask_r")))
    pairs = left.join(right, KEY).where((F.col("chunk_l") <= F.col("chunk_r")) & (apart <= radius))
    pairs = Stored(pairs.select(*KEY, F.col("chunk_l").alias("low"), F.col("chunk_r").alias("high")), "chunk-pairs").df
    first = placed.withColumnRenamed("chunk", "low").join(pairs, [*KEY, "low"]).withColumn("side", F.lit(0))
    second = placed.withColumnRenamed("chunk", "high").join(pairs.where(F.col("low") < F.col("high")), [*KEY, "high"]).withColumn("side", F.lit(1))
    return first.unionByName(second).select(*KEY, "print", "rank", "low", "high", "side")


def hamming_links(prints: DataFrame, radius: int = 4, cut: int = 16384) -> DataFrame:
    """prints(print long, without repeats) to links (u, v) whose connected components are those of all links."""
    n = prints.count()
    choices = [F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("field"), F.lit(first).alias("first")) for k, (m, first) in enumerate(field_masks(radius, fields_for(n, radius)))]
    rows = prints.select("print", F.explode(F.array(*choices)).alias("c")).select("print", "c.*")
    turned = F.expr("(print << first) | CASE WHEN first = 0 THEN 0L ELSE (print >>> (64 - first)) END")
    rows = rows.withColumn("rank", gray_rank(turned)).drop("first")
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    large = Stored(sizes.where(F.col("n") > cut).select(*KEY), "large")
    whole = rows.select(*KEY, "print", "rank", *(F.lit(0).cast("long").alias(c) for c in ("low", "high")), F.lit(0).alias("side"))
    if large.df.limit(1).count():
        whole = whole.join(large.df, KEY, "left_anti").unionByName(_cut_rows(rows.join(large.df, KEY, "left_semi"), radius, cut))
    task = [*KEY, "low", "high"]
    whole = whole.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), *task).sortWithinPartitions(*task, "side", "rank")
    return whole.select(*task, "side", "print").mapInArrow(lambda it: _link_batches(it, radius), "u long, v long")
