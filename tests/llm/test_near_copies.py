"""Near copies of the pipeline against all pairs by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import near_copies

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    near = {i: [j for j in sets if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))] for i in sets}
    label = {i: i for i in sets}
    while (new := {i: min(label[j] for j in near[i]) for i in sets}) != label:
        label = new
    return label


def corpus(seed):
    rng = random.Random(seed)
    sentence = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = [None, "", " \n", "One", "one", "two words"]
    for _ in range(60):
        base = sentence(rng.randint(20, 120))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            new = list(base)
            for _ in range(rng.randint(1, 3)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(new))
    passage, hot = sentence(60), sentence(90)
    texts += [" ".join(sentence(rng.randint(2, 40)) + passage) for _ in range(60)]
    for _ in range(60):
        new = list(hot)
        for k in rng.sample(range(90), rng.randint(0, 3)):
            new[k] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(new))
    texts += [" ".join(hot)] * 20
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "common"), [(1, 100_000), (3, 1)])
def test_every_near_copy_is_found(spark, monkeypatch, seed, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == brute(rows)


def test_the_stage_drops_a_copy_with_one_word_changed(spark, sf_dir):
    words = [f"word{k}" for k in range(50)]
    changed = [*words[:25], "other", *words[26:]]
    far = [*words[:15], "other", *words[16:30], "another", *words[31:]]
    docs = spark.createDataFrame([(k, " ".join(w), "en", "src0", 0) for k, w in ((5, words), (7, changed), (9, far), (None, words), (5, words))], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.without_near_copies(spark, docs, sf_dir).collect()
    want = {i for i, c in brute([(5, " ".join(words)), (7, " ".join(changed)), (9, " ".join(far))]).items() if i == c}
    assert sorted((r.doc_id is None, r.doc_id) for r in left) == sorted([(True, None), *((False, i) for i in want)])
    assert 7 not in want


def test_sketches_never_part_a_link():
    rng = np.random.default_rng(3)
    for n in (1, 2, 60, 70, 500, 5000):
        for _ in range(20):
            both = rng.integers(0, 2**63, n, dtype=np.uint64)
            a = np.unique(np.concatenate([both, rng.integers(0, 2**63, int(rng.integers(0, n)), dtype=np.uint64)]))
            b = np.unique(np.concatenate([both, rng.integers(0, 2**63, int(rng.integers(0, 3 * n)), dtype=np.uint64)]))
            assert near_copies.apart(near_copies.odd_sketch(a), near_copies.odd_sketch(b)) <= len(np.setxor1d(a, b))


def test_a_large_group_of_near_copies_costs_no_pairs(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(900):
        new = list(base)
        for k in rng.sample(range(120), rng.randint(0, 4)):
            new[k] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(new)))
    counts = []
    real = near_copies._possible
    monkeypatch.setattr(near_copies, "_possible", lambda pairs, each: (counts.append(pairs.count()), real(pairs, each))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == brute(rows) and sum(counts) < 6 * len(rows)
