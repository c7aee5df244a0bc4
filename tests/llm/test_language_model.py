"""The language model against plain counts, its filter against exact levels, and both ways to the filter against each other."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language_model as M
from quarry.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, held int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(80)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", "\t", " \x0b", "\r\n"]) for _ in range(n))
    shared = text(50)
    texts = [None, "", " \n", "One", "ONE one", "e w h E", "e", "É é", "\x1c\x85 \xa0x", "w" * 5000, "w" * 5000, "unheard-of " + "v" * 41]
    texts += [text(rng.randint(1, 60)) + shared for _ in range(60)] + [text(4000)] + [shared] * 9
    return [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "no id at all", "", 0), (3, "again and again", "", 0)]


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]


def level(n):
    return n.bit_length()


def middle(j):
    return (2 ** (j - 1) + 2**j - 1) / 2 if j else 0.0


def brute(rows, order):
    """The same model from exact counts: weights by the grid, one order after another."""
    taught = [tokens(t) for i, t, *_ in rows if not held(i)]
    c = Counter(w for t in taught for w in t)
    n_all, types = sum(c.values()), len(c)
    gram = lambda t, i, n: tuple(["<"] * max(0, n - 1 - i) + t[max(0, i - n + 1) : i + 1])
    grams = {n: Counter(gram(t, i, n) for t in taught for i in range(len(t))) for n in range(2, order + 1)}

    def shares(t, i, out):
        for n in range(2, order + 1):
            if n == 2:
                before = c[None] if i == 0 else c[t[i - 1]]
            else:
                before = c[None] if i == 0 else middle(level(grams[n - 1][gram(t, i - 1, n - 1)]))
            met = middle(level(grams[n][gram(t, i, n)]))
            yield (min(1, max(0, (met - out) / max(before - out, 1))), math.frexp(max(before, 1))[1] - 1) if before - out > 0 else (0, -1)

    def mixed(p, found, weights):
        for (share, at), w in zip(found, weights, strict=False):
            g = w.get(at, 0)
            p = g * share + (1 - g) * p
        return p

    weights = []
    for n in range(order - 1):
        sums = {}
        for t in taught:
            for i, w in enumerate(t):
                found = list(shares(t, i, 1))
                p, (share, at) = mixed(c[w] / (n_all + types), found[:n], weights), found[n]
                if at >= 0:
                    sums.setdefault(at, np.zeros(len(M.GRID)))
                    sums[at] += np.log10(M.GRID * share + (1 - M.GRID) * p)
        best = {}
        for at, x in sums.items():
            k = 0
            for j in range(1, len(x)):
                if x[j] > x[k] + 1e-6 * abs(x[j]):
                    k = j
            best[at] = float(M.GRID[k])
        weights.append(best)
    out = []
    for i, t, *_ in rows:
        ts = tokens(t)
        base = [(c[w] + 1) / (n_all + types + 1) for w in ts]
        score = [mixed(p, list(shares(ts, k, 0)), weights) for k, p in enumerate(base)]
        out.append((i, held(i), len(ts), sum(c[w] > 0 for w in ts), n_all, sum(map(math.log10, base)), sum(map(math.log10, score))))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def mark():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


@pytest.mark.parametrize(("order", "block", "most", "grams"), [(2, 1 << 24, 1 << 27, 1 << 19), (3, 3000, 1 << 27, 50), (3, 20_000, -1, 50), (2, 1, -1, 1 << 19)])
def test_scores_equal_plain_counts(spark, order, block, most, grams):
    """Blocks, segments and the way to the filter do not matter; with 64 bits a level the filter hardly errs."""
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    got = M.score_documents(docs, mark(), order, bits=256, block_bytes=block, broadcast_bytes=most, segment_grams=grams).collect()
    close(got, brute(corpus(), order))


def test_query_helps_on_held_out_text(spark, sf_dir):
    rows = QUERIES["op13_language_model"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {r[0]: r for r in brute([(d.doc_id, d.text) for d in docs], 2)}
    for r in rows:
        assert tuple(r)[:5] == want[r.doc_id][:5] and r.base_score == pytest.approx(want[r.doc_id][5])
        assert r.score <= 0
    out = [r for r in rows if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)
    exact, found = sum(want[r.doc_id][6] for r in rows), sum(r.score for r in rows)
    assert abs(found - exact) < 0.02 * abs(exact)


def test_filter_never_underrates():
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64) * np.uint64(2))
    counts = np.minimum(rng.zipf(1.6, len(grams)), 10**6)
    power = 4
    number = M.segment_of(grams, power)
    held = M.Segments(power, [(k, M.segment_bits(grams[number == k], counts[number == k], 10)) for k in range(16)])
    exact, found = M.levels_of(counts), held.levels(grams)
    assert (found >= exact).all() and (found == exact).mean() > 0.95
    new = np.unique(rng.integers(0, 2**63, 50_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert (held.levels(new) > 0).mean() < 0.05
    assert M.Segments(power, []).levels(new).sum() == 0


def test_stretches_of_documents(monkeypatch):
    seqs = [np.zeros(n, np.int32) for n in (1, 700, 3, 2, 900, 1)]
    monkeypatch.setattr(M, "STEP", 500)
    parts = list(M.steps(seqs))
    assert [k for p in parts for k in range(p.start, p.stop)] == list(range(6)) and len(parts) == 3 and list(M.steps([])) == []
    words = np.arange(5, dtype=np.uint64)
    seqs = [np.array(x, np.int32) for x in ([1, 2, 0], [2, 0], [0])]
    for n in (2, 3):
        whole = M.gram_hashes(words, seqs, n)
        assert (whole == np.concatenate([M.gram_hashes(words, [q], n) for q in seqs])).all()


def test_words_of_slices(monkeypatch):
    text = ("one two\n" * 500 + "x" * 900 + " three").encode()
    want = text.split()
    monkeypatch.setattr(M, "SLICE", 50)
    assert [w for part in M.word_lists(text) for w in part] == want


def test_empty_table_and_no_training(spark):
    assert M.score_documents(spark.createDataFrame([], SCHEMA), mark()).count() == 0
    out = M.score_documents(spark.createDataFrame(corpus(), SCHEMA), F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in out)
