"""The factorization machine against its definition: the sum over all pairs, and one training step against numerical slopes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from quarry.llm.toxicity import Machine


def made(inputs=9, factors=3, seed=1):
    m = Machine(np.arange(inputs), factors, -0.4, seed)
    m.linear = np.random.default_rng(seed).normal(0, 0.5, inputs)
    m.pairs *= 10
    return m


def plain(m, row):
    return m.bias + sum(m.linear[i] for i in row) + sum(m.pairs[i] @ m.pairs[j] for i, j in combinations(row.tolist(), 2))


def test_raw_is_the_sum_over_pairs():
    m = made()
    for row in ([], [4], [0, 8], [1, 2, 5, 7], list(range(9))):
        assert m.raw(np.array(row, np.int64)) == pytest.approx(plain(m, np.array(row, np.int64)))
    assert m.score(np.array([0, 8])) == pytest.approx(1 / (1 + np.exp(-plain(m, np.array([0, 8])))))


def test_a_pair_can_say_what_its_parts_do_not():
    m = made()
    m.linear[:] = 0
    m.pairs[:] = 0
    m.pairs[2], m.pairs[3] = [2, 0, 0], [2, 0, 0]
    assert m.raw(np.array([2])) == m.raw(np.array([3])) == m.bias and m.raw(np.array([2, 3])) == pytest.approx(m.bias + 4)


def test_one_step_follows_the_slopes():
    rows, labels = [np.array(x, np.int64) for x in ([0, 1, 2], [2, 3], [4], [1, 5, 6])], np.array([1.0, 0.0, 1.0, 0.0])
    decay, rate = 0.3, 0.2
    used = np.unique(np.concatenate(rows))

    def loss(m):
        raw = np.array([plain(m, r) for r in rows])
        return np.mean(np.log1p(np.exp(-raw)) * labels + np.log1p(np.exp(raw)) * (1 - labels)) + decay / (2 * len(rows)) * ((m.linear[used] ** 2).sum() + (m.pairs[used] ** 2).sum())

    def slope(change):
        up, down = made(), made()
        change(up, 1e-5)
        change(down, -1e-5)
        return (loss(up) - loss(down)) / 2e-5

    before, after = made(), made()
    after.fit(rows, labels, epochs=1, rate=rate, decay=decay, seed=3, batch=64)
    step = lambda g: rate * g / np.sqrt(1e-2 + g * g)

    def bias(m, d):
        m.bias += d

    assert before.bias - after.bias == pytest.approx(step(slope(bias)), abs=1e-6)
    for i in range(9):

        def linear(m, d, i=i):
            m.linear[i] += d

        assert before.linear[i] - after.linear[i] == pytest.approx(step(slope(linear)) if i in used else 0, abs=1e-5)
        for f in range(3):

            def pair(m, d, i=i, f=f):
                m.pairs[i, f] += d

            assert before.pairs[i, f] - after.pairs[i, f] == pytest.approx(step(slope(pair)) if i in used else 0, abs=1e-5)
