"""Keypoints of grey images, their matches, and the scale and shift that most matches agree on. One row is one pair of photographs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: margin and step of the grid that is looked at, least response, least distance of two keypoints
MARGIN, STEP, LEAST, APART = 6, 2, 40, 6
# fixed values: largest distance of a match, and how much nearer it has to be than the next
NEAR, RATIO = 40, 0.75
# fixed values: rounds of the fit, pixels within which a match agrees, scales that are taken, least squared distance of two matches
ROUNDS, WITHIN, SCALES, SPREAD = 64, 8.0, (0.3, 3.2), 4


def _tests() -> np.ndarray:
    """The 128 pairs of places that a descriptor compares, each as dx1, dy1, dx2, dy2."""
    i = np.arange(128)
    return np.stack([(i * a + b) % 13 - 6 for a, b in ((17, 3), (29, 5), (13, 7), (23, 11))], axis=1)


def keypoints(grey: np.ndarray, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the strongest edges, each apart from stronger ones, and 128 bits of comparisons around each; grey is [y, x]."""
    g = grey.astype(np.int64)
    height, width = g.shape
    if min(height, width) <= 2 * MARGIN:
        return np.zeros((0, 2), np.int64), np.zeros((0, 16), np.uint8)
    around = sum(np.roll(g, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    response = np.clip(9 * g - around, 0, 255)
    y, x = np.meshgrid(np.arange(MARGIN, height - MARGIN, STEP), np.arange(MARGIN, width - MARGIN, STEP), indexing="ij")
    x, y = x.ravel(), y.ravel()
    found = response[y, x] >= LEAST
    x, y = x[found], y[found]
    order = np.lexsort((y, x, response[y, x]))[::-1]
    taken, points = np.zeros((height, width), bool), []
    for px, py in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if not taken[py, px]:
            points.append((px, py))
            taken[max(0, py - APART + 1) : py + APART, max(0, px - APART + 1) : px + APART] = True
            if len(points) == most:
                break
    at = np.array(points, np.int64).reshape(-1, 2)
    t = _tests()
    x1, y1, x2, y2 = (at[:, [k % 2]] + t[None, :, k] for k in range(4))
    inside = np.ones(x1.shape, bool)
    for cx, cy in ((x1, y1), (x2, y2)):
        inside &= (cx >= 0) & (cx < width) & (cy >= 0) & (cy < height)
    clip = lambda c, n: np.clip(c, 0, n - 1)
    bits = inside & (g[clip(y1, height), clip(x1, width)] > g[clip(y2, height), clip(x2, width)])
    return at, np.packbits(bits, axis=1)


def matched(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(i, j) of descriptors whose nearest partner is near, and much nearer than the next; of equal ones the first."""
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64)
    d = np.bitwise_count(left[:, None, :] ^ right[None, :, :]).sum(axis=2).astype(np.int64)
    best = d.argmin(axis=1)
    rows = np.arange(len(left))
    first = d[rows, best]
    d[rows, best] = 10_000
    second = d.min(axis=1)
    good = (first < NEAR) & ((second == 0) | (first / np.maximum(1, second) <= RATIO))
    return np.stack([rows[good], best[good]], axis=1)


def fit(points: np.ndarray, targets: np.ndarray) -> tuple[int, float, bool]:
    """Matches that agree on one scale and shift, their mean error in pixels, and whether targets are mirrored.

    Each round takes two matches by its number; the first round with most agreement counts, unmirrored ones first.
    """
    n, best = len(points), (0, 99.0, False)
    if n < 3:
        return best
    for mirrored in (False, True):
        w = targets * np.array([-1.0, 1.0]) if mirrored else targets
        seed = np.arange(ROUNDS)
        one, two = seed % n, (seed * 3 + 1) % n
        p, q = points[two] - points[one], w[two] - w[one]
        span = (p * p).sum(axis=1)
        ok = (one != two) & (span >= SPREAD)
        scale = np.sqrt((q * q).sum(axis=1) / np.where(ok, span, 1))
        ok &= (scale >= SCALES[0]) & (scale <= SCALES[1])
        shift = w[one] - scale[:, None] * points[one]
        error = np.sqrt(((scale[:, None, None] * points[None] + shift[:, None, :] - w[None]) ** 2).sum(axis=2))
        near = (error <= WITHIN) & ok[:, None]
        hits = near.sum(axis=1)
        k = int(hits.argmax())
        if hits[k] > best[0]:
            best = int(hits[k]), float((error[k] * near[k]).sum() / hits[k]), mirrored
    return best


def fitted(matches: DataFrame) -> DataFrame:
    """matches(pair_id, at, x, y, u, v) to pair_id, matches, inliers, ratio, residual, mirrored; at is the order of a pair's matches.

    A pair has as many matches as a photograph has keypoints at most.
    """

    names = ["pair_id", "matches", "inliers", "ratio", "residual", "mirrored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b.column("m")).to_numpy()
            m = b.column("m").flatten()
            points, targets = (np.stack([m.field(c).to_numpy(zero_copy_only=False) for c in cs], axis=1) for cs in ("xy", "uv"))
            ends = np.cumsum(size)
            out = [fit(points[e - n : e], targets[e - n : e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            if out:
                hits, residual, mirrored = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("pair_id"), pa.array(size.astype(np.int64)), pa.array(hits, pa.int64()), pa.array(np.array(hits) / size), pa.array(residual, pa.float64()), pa.array(mirrored)], names=names)

    each = F.struct("at", *(F.col(c).cast("double").alias(c) for c in "xyuv"))
    whole = matches.groupBy(F.col("pair_id").cast("long").alias("pair_id")).agg(F.sort_array(F.collect_list(each)).alias("m"))
    return whole.mapInArrow(run, "pair_id long, matches long, inliers long, ratio double, residual double, mirrored boolean")


def compared(pairs: DataFrame, most: int = 200) -> DataFrame:
    """pairs(pair_id, left, left_width, right, right_width), images as rows of grey bytes, to pair_id, matches, inliers, ratio, residual, mirrored."""

    def image(data: bytes | None, width: int | None) -> np.ndarray:
        return np.frombuffer(data, np.uint8).reshape(-1, width) if data and width and len(data) % width == 0 else np.zeros((0, 0), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pair, left, lw, right, rw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                (p, a), (q, z) = keypoints(image(left, lw), most), keypoints(image(right, rw), most)
                m = matched(a, z)
                hits, residual, mirrored = fit(p[m[:, 0]].astype(float), q[m[:, 1]].astype(float))
                out.append((pair, len(m), hits, hits / max(1, len(m)), residual, mirrored))
            if out:
                names = ["pair_id", "matches", "inliers", "ratio", "residual", "mirrored"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    return pairs.select("pair_id", "left", "left_width", "right", "right_width").mapInArrow(run, "pair_id long, matches long, inliers long, ratio double, residual double, mirrored boolean")
