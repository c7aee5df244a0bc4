"""Exact top-k by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. A cell holds vectors of one pivot, of a range of
distances (rows are dealt by ranges of pivot and distance, and a cell closes after CELL of them), and is cut into annuli.
A query meets the annuli from its own distance outwards. By the triangle inequality a vector in an annulus is at least `gap` away, the difference of
the two distances to the pivot, so its inner product is at most (|query|^2 + largest |vector|^2 - gap^2) / 2; a query
leaves a cell when no annulus left can reach its k-th score. A first round in each query's own cell gives that score,
and a query is sent to those cells only whose bound reaches it, first by pivot, then by cell.

The pivots are a bounded sample, a quarter of the root of the number of vectors, from 64 to 4096, unless given; all
vectors are indexed and the result is exact.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id;
vectors of another length than the query's are no candidates; rows with the query's own vec_id are none either.
Repeated query rows are answered once. Scores must fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.frames import stored

ANNULUS, CELL, BLOCK = 256, 8192, 256
KEYED = "vec_id long, dim int, pivot int, dist double, vec binary"


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as double."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select("vec_id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def choose_pivots(vectors: DataFrame, count: int = 64) -> dict[int, np.ndarray]:
    """By vector length: at most `count` pivots in all, chosen by a hash of the ids."""
    out: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect():
        out.setdefault(len(r["v"]), []).append(r["v"])
    return {d: np.unique(np.array(v, np.float64).reshape(len(v), d), axis=0) for d, v in out.items()}


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def keyed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """KEYED rows; a length that no pivot has is keyed by its distance to the origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
            size = np.diff(np.asarray(lists.offsets))
            start = np.concatenate([[0], np.cumsum(size)])
            for d in np.unique(size):
                own = np.nonzero(size == d)[0]
                x = flat[start[own][:, None] + np.arange(d)].reshape(len(own), d)
                far = distances(x.astype(np.float64), pivots.get(int(d), np.zeros((1, d))))
                near = far.argmin(axis=1)
                columns = [pa.array(ids[own]), pa.array(np.full(len(own), d, np.int32)), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(own)), near]), pa.array([r.tobytes() for r in x], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "pivot", "dist", "vec"])

    return vectors.select("vec_id", "v").mapInArrow(run, KEYED)


class _Cell:
    """Sorted vectors of one cell, in annuli."""

    def __init__(self, ids: np.ndarray, dist: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        at = np.arange(0, len(ids), ANNULUS)
        self.low, self.high = dist[at], dist[np.minimum(at + ANNULUS, len(ids)) - 1]
        self.norm = np.maximum.reduceat((x * x).sum(axis=1), at)
        self.exact = not len(x) or float(np.abs(x).max(initial=0)) < 2**20

    def search(self, qid: np.ndarray, qdist: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its best (scores, ids) here, those below its floor left out."""
        gap = np.maximum(0, np.maximum(self.low[None, :] - qdist[:, None], qdist[:, None] - self.high[None, :]) - 1e-6 * (1 + qdist[:, None]))
        bound = ((q * q).sum(axis=1)[:, None] + self.norm[None, :] - gap * gap) / 2
        bound += 1 + 1e-9 * np.abs(bound)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qid)
        worst = floor.copy()
        fits = self.exact and float(np.abs(q).max(initial=0)) < 2**20 and q.shape[1] < 2**12
        for a in np.argsort(gap.mean(axis=0), kind="stable"):
            live = np.nonzero(bound[:, a] >= worst)[0]
            if not len(live):
                continue
            part = slice(a * ANNULUS, (a + 1) * ANNULUS)
            ids = self.ids[part]
            s = np.rint(q[live] @ self.x[part].T).astype(np.int64) if fits else q[live].astype(np.int64) @ self.x[part].astype(np.int64).T
            take = (s >= worst[live][:, None]) & (ids[None, :] != qid[live][:, None])
            for r in np.nonzero(take.any(axis=1))[0]:
                i, own = live[r], take[r]
                scores, names = np.concatenate([best[i][0], s[r][own]]), np.concatenate([best[i][1], ids[own]])
                order = np.lexsort((names, -scores))[:k]
                best[i] = scores[order], names[order]
                if len(order) == k:
                    worst[i] = max(worst[i], scores[order[-1]])
        return best


def _search_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (dim, pivot, part, kind, dist, vec_id, vec, floor) sorted so that a cell's vectors come before its queries."""
    key, cell, vectors, queries = None, None, [], []

    def block() -> pa.RecordBatch | None:
        nonlocal queries, cell, vectors
        if cell is None and vectors:
            dim = key[0]
            cell = _Cell(np.array([v[0] for v in vectors], np.int64), np.array([v[1] for v in vectors]), np.frombuffer(b"".join(v[2] for v in vectors), np.int64).reshape(len(vectors), dim).astype(np.float64))
            vectors = []
        own, queries = queries, []
        if cell is None or not own:
            return None
        found = cell.search(np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own]), np.frombuffer(b"".join(r[2] for r in own), np.int64).reshape(len(own), key[0]).astype(np.float64), np.array([r[3] for r in own]), k)
        n = [len(f[0]) for f in found]
        if not sum(n):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in own], n), pa.int64()), pa.array([r[2] for r, c in zip(own, n, strict=True) for _ in range(c)], pa.binary()), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[0] for f in found]))], names=["query_id", "vec", "vec_id", "score"])

    for b in batches:
        for dim, pivot, part, kind, dist, vec_id, vec, floor in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (dim, pivot, part) != key:
                if (out := block()) is not None:
                    yield out
                key, cell, vectors, queries = (dim, pivot, part), None, [], []
            if kind == 0:
                vectors.append((vec_id, dist, vec))
            else:
                queries.append((vec_id, dist, vec, floor))
                if len(queries) == BLOCK and (out := block()) is not None:
                    yield out
    if key is not None and (out := block()) is not None:
        yield out


def _cells(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by dim, pivot and distance with `part`: a number for each `size` rows of one pivot."""
    key, base, seen, top = None, 0, 0, TaskContext.get().partitionId() << 32
    for b in batches:
        dim, pivot = b.column("dim").to_numpy(), b.column("pivot").to_numpy()
        edge = np.concatenate([[0], np.nonzero((dim[1:] != dim[:-1]) | (pivot[1:] != pivot[:-1]))[0] + 1, [b.num_rows]])
        part = np.zeros(b.num_rows, np.int64)
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if s == e:
                continue
            if (dim[s], pivot[s]) != key:
                base, key, seen = base + -(-seen // size), (dim[s], pivot[s]), 0
            part[s:e] = top + base + (seen + np.arange(e - s)) // size
            seen += e - s
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], names=[*b.schema.names, "part"])


def _visits(queries: DataFrame, pivots: dict[int, np.ndarray], extent: dict[tuple[int, int], tuple[float, float, float]]) -> DataFrame:
    """Each query (vec_id, dim, vec, floor) once for every pivot whose bound reaches its floor, with its squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for d in {r["dim"] for r in rows}:
                own = [r for r in rows if r["dim"] == d]
                q = np.frombuffer(b"".join(r["vec"] for r in own), np.int64).reshape(len(own), d).astype(np.float64)
                far, floor, norm = distances(q, pivots.get(d, np.zeros((1, d)))), np.array([r["floor"] for r in own]), (q * q).sum(axis=1)
                for p in range(far.shape[1]):
                    if (d, p) not in extent:
                        continue
                    low, high, top = extent[d, p]
                    gap = np.maximum(0, np.maximum(low - far[:, p], far[:, p] - high) - 1e-6 * (1 + far[:, p]))
                    bound = (norm + top - gap * gap) / 2
                    go = np.nonzero(bound + 1 + 1e-9 * np.abs(bound) >= floor)[0]
                    if len(go):
                        yield pa.RecordBatch.from_arrays([pa.array([own[i]["vec_id"] for i in go], pa.int64()), pa.array(np.full(len(go), d, np.int32)), pa.array(np.full(len(go), p, np.int32)), pa.array(far[go, p]), pa.array([own[i]["vec"] for i in go], pa.binary()), pa.array(floor[go]), pa.array(norm[go])], names=["vec_id", "dim", "pivot", "dist", "vec", "floor", "square"])

    return queries.select("vec_id", "dim", "vec", "floor").mapInArrow(run, "vec_id long, dim int, pivot int, dist double, vec binary, floor double, square double")


def _reached(visits: DataFrame, extents: DataFrame) -> DataFrame:
    """Visits to the cells of their pivots whose bound reaches their floor."""
    gap = F.greatest(F.lit(0.0), F.greatest(F.col("low") - F.col("dist"), F.col("dist") - F.col("high")) - 1e-6 * (1 + F.col("dist")))
    bound = (F.col("square") + F.col("norm") - gap * gap) / 2
    met = visits.join(extents.select("dim", "pivot", "part", "low", "high", "norm"), ["dim", "pivot"])
    return met.where(bound + 1 + 1e-9 * F.abs(bound) >= F.col("floor")).drop("low", "high", "norm", "square")


def _search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    cell = ["dim", "pivot", "part"]
    rows = vectors.select(*cell, F.lit(0).alias("kind"), "dist", "vec_id", "vec", F.lit(0.0).alias("floor"))
    rows = rows.unionByName(queries.select(*cell, F.lit(1).alias("kind"), "dist", "vec_id", "vec", "floor"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell).sortWithinPartitions(*cell, "kind", "dist", "vec_id")
    return rows.mapInArrow(lambda it: _search_batches(it, k), "query_id long, vec binary, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "vec").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with `is_query` the k best of all other rows, ties to smaller ids."""
    vectors, size = integer_vectors(embeddings), CELL
    chosen = choose_pivots(vectors, pivots or min(4096, max(64, math.isqrt(vectors.count()) // 4)))
    # a place in the input parts rows that repeat an id or a whole vector without end
    order = ["dim", "pivot", "dist", "_at"]
    n = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed(vectors, chosen).withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_at")
    cells = stored(ranged.mapInArrow(lambda it: _cells(it, size), f"{KEYED}, part long"), "cells")
    extents = stored(cells.mapInArrow(_norms, "dim int, pivot int, part long, low double, high double, norm double").groupBy("dim", "pivot", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")), "extents")
    whole = extents.groupBy("dim", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")).collect()  # a row for each pivot
    queries = cells.where(F.coalesce(is_query, F.lit(False))).dropDuplicates(["vec_id", "vec"])
    first = _ranked(_search(cells, queries.withColumn("floor", F.lit(float("-inf"))), k), k).where(F.col("rank") == k)
    floors = first.select(F.col("query_id").alias("vec_id"), "vec", F.col("score").cast("double").alias("floor"))
    asked = stored(queries.join(floors, ["vec_id", "vec"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "queries")
    visits = _visits(asked, chosen, {(r["dim"], r["pivot"]): (r["low"], r["high"], r["norm"]) for r in whole})
    best = _ranked(_search(cells, _reached(visits, extents), k), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dim, pivot, dist, part = (b.column(c).to_numpy() for c in ("dim", "pivot", "dist", "part"))
        vec = b.column("vec").to_pylist()
        norm = np.array([float((np.frombuffer(v, np.int64).astype(np.float64) ** 2).sum()) for v in vec])
        yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array(pivot), pa.array(part), pa.array(dist), pa.array(dist), pa.array(norm)], names=["dim", "pivot", "part", "low", "high", "norm"])
