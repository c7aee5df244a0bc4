"""Keypoints, matches and the fit against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quarry.operators import keypoints as K


def plain_points(g, most):
    h, w = g.shape
    found = []
    for y in range(6, h - 6, 2):
        for x in range(6, w - 6, 2):
            r = max(0, min(255, 8 * int(g[y, x]) - sum(int(g[y + a, x + b]) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
            if r >= 40:
                found.append((r, x, y))
    points = []
    for _, x, y in sorted(found, reverse=True):
        if not any(abs(x - a) < 6 and abs(y - b) < 6 for a, b in points):
            points.append((x, y))
    return points[:most]


def plain_bits(g, x, y):
    h, w = g.shape
    out = []
    for i in range(128):
        x1, y1, x2, y2 = x + (i * 17 + 3) % 13 - 6, y + (i * 29 + 5) % 13 - 6, x + (i * 13 + 7) % 13 - 6, y + (i * 23 + 11) % 13 - 6
        inside = all(0 <= c < w for c in (x1, x2)) and all(0 <= c < h for c in (y1, y2))
        out.append(int(inside and g[y1, x1] > g[y2, x2]))
    return out


def plain_fit(p, q):
    best = (0, 99.0, False)
    if len(p) < 3:
        return best
    for mirrored in (False, True):
        w = [(-a if mirrored else a, b) for a, b in q]
        for seed in range(64):
            i, j = seed % len(p), (seed * 3 + 1) % len(p)
            d = math.dist(p[i], p[j]) ** 2
            if i == j or d < 4:
                continue
            s = math.dist(w[i], w[j]) / math.sqrt(d)
            if not 0.3 <= s <= 3.2:
                continue
            errors = [math.hypot(s * a + w[i][0] - s * p[i][0] - u, s * b + w[i][1] - s * p[i][1] - v) for (a, b), (u, v) in zip(p, w, strict=True)]
            near = [e for e in errors if e <= 8]
            if len(near) > best[0]:
                best = len(near), sum(near) / len(near), mirrored
    return best


def test_points_and_bits_against_loops():
    rng = np.random.default_rng(2)
    for shape in ((40, 60), (64, 64), (13, 13), (12, 30), (0, 0)):
        g = rng.integers(0, 256, shape).astype(np.uint8)
        at, bits = K.keypoints(g, 30)
        assert [tuple(x) for x in at.tolist()] == (plain_points(g, 30) if min(shape) > 12 else [])
        assert [np.unpackbits(b).tolist() for b in bits] == [plain_bits(g, x, y) for x, y in at.tolist()]


def test_fit_against_loops():
    rng = np.random.default_rng(5)
    for n in (0, 2, 3, 7, 40, 100):
        for mirror in (1, -1):
            p = rng.integers(0, 200, (n, 2)).astype(float)
            q = p * 1.5 * [mirror, 1] + [4, -9] + rng.normal(0, 3, (n, 2)) if n else p
            q[: n // 3] = rng.integers(0, 200, (n // 3, 2))
            got, want = K.fit(p, q), plain_fit(p.tolist(), q.tolist())
            assert (got[0], got[2]) == (want[0], want[2]) and got[1] == pytest.approx(want[1])


def test_shifted_photographs_agree(spark):
    rng = np.random.default_rng(9)
    whole = np.kron(rng.integers(0, 256, (12, 12)), np.ones((8, 8))).astype(np.uint8) + rng.integers(0, 20, (96, 96)).astype(np.uint8)
    left, right = np.ascontiguousarray(whole[:80, :80]), np.ascontiguousarray(whole[4:84, 6:86])
    other = rng.integers(0, 256, (80, 80)).astype(np.uint8)
    rows = [(1, left.tobytes(), 80, right.tobytes(), 80), (2, left.tobytes(), 80, other.tobytes(), 80), (3, None, None, b"", 5), (4, b"abc", 2, left.tobytes(), 80)]
    got = {r.pair_id: r for r in K.compared(spark.createDataFrame(rows, "pair_id long, left binary, left_width int, right binary, right_width int")).collect()}
    assert got[1].inliers >= 10 and got[1].ratio > 0.7 and got[1].residual < 1 and not got[1].mirrored
    assert got[2].inliers < got[1].inliers / 2 and (got[3].matches, got[3].inliers) == (0, 0) == (got[4].matches, got[4].inliers)


def test_matches_need_a_clear_winner():
    zero, one = np.zeros((1, 16), np.uint8), np.full((1, 16), 255, np.uint8)
    near = zero.copy()
    near[0, 0] = 7
    assert K.matched(zero, np.concatenate([one, near])).tolist() == [[0, 1]]
    assert K.matched(zero, np.concatenate([near, near])).tolist() == [] and K.matched(zero, one).tolist() == [] and K.matched(zero, zero[:0]).tolist() == []


def test_pairs_are_fitted_in_batches_and_not_one_call_each(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["agreeing_matches"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
