"""Deduplication, sharding and toxicity against brute force, with nulls, ties, repeats, long texts and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quarry.llm import hamming, line_dedup, sharding, simhash, suffix, toxicity
from quarry.llm.components import components

SCHEMA = "doc_id long, text string, component_id string, n_lines int, score string, slot string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeéñ", k=rng.randint(2, 6))) for _ in range(60)]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    passage = sentence(60)
    texts = [None, "", " \t\n", "One", "one", "two words", sentence(4)]
    texts += [sentence(rng.randint(3, 80)) + "\n" + passage + "\n" + sentence(rng.randint(1, 40)) for _ in range(12)]
    base = sentence(120)
    texts += [base] * 5 + [base + " x", base.replace("a", "A", 1), base.upper(), base + "\n" + base]
    texts += ["a" * 700, "ab" * 300, sentence(9000), "Repeated line here\nshort\nREPEATED LINE HERE \n\nshort", "repeated line here\nown line of this text", "\n\n\n"]
    texts += [sentence(rng.randint(5, 200)).replace(" ", "\n", 3) for _ in range(20)]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, "clash", "clash") for i, t in rows], SCHEMA).repartition(5)


def brute_simhash(text):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, rows):
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_simhash(t) for i, t in rows}
    assert {i: g[0] for i, g in got.items()} == prints
    label = {i: i for i in prints}
    for _ in prints:
        new = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        if new == label:
            break
        label = new
    assert {i: g[1] for i, g in got.items()} == label


def test_simhash_slabs_do_not_matter(monkeypatch):
    text = " ".join(str(i * i) for i in range(3000)).encode()
    whole = simhash.simhash(text)
    for slab in (1, 7, 100, 5000):
        monkeypatch.setattr(simhash, "SLAB", slab)
        assert simhash.simhash(text) == whole


def test_simhash_keeps_one(spark, docs):
    out = simhash.keep_one(docs)
    left = {r.doc_id for r in out.collect()}
    want = {r.doc_id for r in simhash.near_duplicates(docs).collect() if r.doc_id == r.component_id}
    assert left == want and out.columns == docs.columns
    nulls = spark.createDataFrame([(None, "same text here now"), (None, "same text here now"), (4, "same text here now"), (4, "same text here now")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id) for r in simhash.keep_one(nulls).collect()) == [(False, 4), (True, None), (True, None)]


@pytest.mark.parametrize("shape", ["random", "dense", "two sides"])
def test_gray_index_finds_every_component(shape):
    rng = np.random.default_rng(5)
    if shape == "random":
        x = rng.integers(0, 2**63, 900, dtype=np.uint64)
        flips = x[:400] ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64))
        x = np.unique(np.concatenate([x, flips]))
    else:
        center = np.uint64(0x0123456789ABCDEF)
        x = np.full(3000, center)
        for _ in range(7):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
        x = np.unique(x)

    def rank(v):
        for s in (1, 2, 4, 8, 16, 32):
            v = v ^ (v >> np.uint64(s))
        return v

    def join(n, pairs):
        p = list(range(n))

        def find(a):
            while p[a] != a:
                p[a] = p[p[a]]
                a = p[a]
            return a

        for a, b in pairs:
            a, b = find(a), find(b)
            p[max(a, b)] = min(a, b)
        return [find(a) for a in range(n)]

    x = x[np.argsort(rank(x))]
    place = {int(v): k for k, v in enumerate(x)}
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    if shape == "two sides":
        half = rng.random(len(x)) < 0.5
        a, b = x[half], x[~half]
        near &= half[:, None] != half[None, :]
        u, v = hamming.linked(a, b, 4)
    else:
        u, v = hamming.linked(x, None, 4)
    i, j = np.nonzero(near)
    keep = i < j
    want = join(len(x), zip(i[keep].tolist(), j[keep].tolist(), strict=True))
    got = join(len(x), [(place[int(p)], place[int(q)]) for p, q in zip(u, v, strict=True)])
    assert got == want


@pytest.mark.parametrize("cut", [4, 40])
def test_large_groups_are_cut_without_losing_links(spark, cut):
    rng = random.Random(8)
    base = 0x1234_5678_9ABC_DEF0
    prints = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(500)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    links = hamming.hamming_links(frame, 4, cut=cut)
    got = {r.node % 2**64: r.root for r in components(links).collect()}
    label = {p: p for p in prints}
    for _ in prints:
        new = {p: min(label[q] for q in prints if (p ^ q).bit_count() <= 4) for p in prints}
        if new == label:
            break
        label = new
    groups = defaultdict(set)
    for p in prints:
        groups[label[p]].add(got.get(p, ("alone", p)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chain_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200, 200 + i) for i in range(1, 30)] + [(7, 3), (3, 7)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(200 + i, 200) for i in range(30)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(rows, n):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[p : p + n] for p in range(len(b) - n + 1))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram", "buffer"), [(200, 150, 1 << 17), (50, 20, 400), (33, 32, 200)])
def test_suffix_against_all_windows(docs, rows, monkeypatch, length, gram, buffer):
    monkeypatch.setattr(suffix, "BUFFER", buffer)
    out = suffix.removal_digests(suffix.remove_repeats(docs, length, gram)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_repeats(rows, length)


def test_suffix_rows_without_and_with_the_same_id(spark):
    long = "".join(random.Random(2).choices("abcdefgh", k=300))
    other = "".join(random.Random(4).choices("abcdefgh", k=300))
    frame = spark.createDataFrame([(None, long), (None, other), (5, long), (5, other[:250] + "x"), (6, "zz")], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_removed) for r in suffix.removal_digests(suffix.remove_repeats(frame)).collect())
    assert got == Counter([(None, 300), (None, 250), (5, 300), (5, 250), (6, 0)])


def brute_lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                owner[key(line)] = min(owner.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < least or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 3), (4, 3), (7, 2)])
def test_lines_against_brute_force(docs, rows, batches, fanout):
    out = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out) == sorted(brute_lines(rows))


def test_lines_of_repeated_and_missing_ids(spark):
    rows = [(None, "a line of some length\nx"), (3, "a line of some length"), (3, "a line of some length\nmore"), (2, "A LINE OF SOME LENGTH\t"), (None, None)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    norm = lambda rs: sorted((str(a), b, c, d) for a, b, c, d in rs)
    assert norm((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out) == norm(brute_lines(rows))


def test_shards(docs, rows):
    out = sharding.shard_documents(docs, shards=5).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    places = defaultdict(list)
    for r in out:
        places[r.shard].append(r.slot)
    assert set(places) <= set(range(5)) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_shards_of_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "x" * 50)] * 40 + [(None, None)] * 3, "doc_id long, text string")
    out = sharding.shard_documents(frame, shards=3).collect()
    assert len(out) == 43 and len({(r.shard, r.slot) for r in out}) == 43


def test_shard_sizes_and_rebalancing(spark, tmp_path):
    rng = random.Random(1)
    totals = spark.createDataFrame([(s, 10, rng.randint(1, 1000)) for s in range(sharding.SLOTS)], "vslot int, rows long, bytes long")
    m = sharding.SlotMap.build(totals, 40)
    load = Counter()
    for s, h in m.shard.items():
        load[h] += m.totals[s][1]
    assert max(load.values()) < 1.01 * min(load.values())
    grown = m.rebalanced(totals, 41)
    moved = [s for s in m.shard if m.shard[s] != grown.shard[s]]
    size = {s: m.totals[s][1] for s in m.shard}
    assert grown.version == 1 and sum(size[s] for s in moved) < 1.2 * sum(size.values()) / 41 and set(grown.shard.values()) == set(range(41))
    assert {grown.shard[s] for s in moved if size[s] > 500} <= {40}
    m.save(spark, str(tmp_path))
    grown.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 0).shard == m.shard and sharding.SlotMap.load(spark, str(tmp_path), 1).shard == grown.shard


def test_toxicity_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) >= 0.95
    assert not any(r.predicted and not r.toxic for r in held)


def test_toxicity_learns_a_pair():
    """Two terms that are harmless apart: a sum of weights could not tell."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({0} | ({1} if a else set()) | ({2} if b else set()) | {int(rng.integers(3, 30))})))
        labels.append(float(a != b))
    m = toxicity.Machine(np.arange(30), 8, 0.0, 1)
    m.fit(rows, np.array(labels), 60, 0.2, 0.0, 1)
    assert np.mean([(m.score(r) >= 0.5) == bool(y) for r, y in zip(rows, labels, strict=True)]) > 0.97


def test_toxicity_without_labels_or_terms(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i, _ in rows] + [(rows[0][0], None)], "doc_id long, toxic int")
    assert all(0.5 < r.score <= 1 for r in toxicity.toxicity(docs, one).collect())


def test_toxicity_words_in_slabs(monkeypatch):
    text = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500))
    whole = toxicity.words(text)
    monkeypatch.setattr(toxicity, "SLAB", 50)
    assert toxicity.words(text) == whole


@pytest.mark.parametrize("name", ["near_duplicates", "remove_repeats", "dedup_lines", "shard_documents", "toxicity"])
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    make = {"near_duplicates": simhash.near_duplicates, "remove_repeats": suffix.remove_repeats, "dedup_lines": line_dedup.dedup_lines, "shard_documents": sharding.shard_documents, "toxicity": lambda d: toxicity.toxicity(d, labels)}[name]
    assert make(docs).count() == 0


def test_native_operators_run_no_python(docs):
    for frame in (line_dedup.dedup_lines(docs), sharding.shard_documents(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    frame = sharding.records(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in frame._jdf.queryExecution().executedPlan().toString()


def test_shards_stay_even_when_a_third_of_rows_are_equal(spark):
    rng = random.Random(4)
    frame = spark.createDataFrame([(i, "t" * rng.randint(0, 200)) for i in range(2000)] + [(7, "hot row " * 6)] * 1000, "doc_id long, text string")
    out = sharding.shard_documents(frame, shards=6).collect()
    load, places = Counter(), defaultdict(list)
    for r in out:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert len(out) == 3000 and max(load.values()) < 1.05 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rows_are_placed_by_the_stored_map(spark, docs, tmp_path):
    out = sharding.shard_documents(docs, shards=5, maps=str(tmp_path)).collect()
    first = sharding.SlotMap.load(spark, str(tmp_path), 0)
    assert all(first.shard[r.vslot] == r.shard for r in out)
    grown = first.rebalanced(sharding.slot_totals(sharding.records(docs)), 6)
    grown.save(spark, str(tmp_path))
    again = sharding.SlotMap.load(spark, str(tmp_path), 1)
    assert again.shard == grown.shard and again.shards == 6
    placed = {r.vslot: r.shard for r in sharding.shard_documents(docs, shards=6).collect()}
    assert set(placed) == {s for s in first.totals}


def test_line_runs_do_not_use_the_warehouse(spark, docs):
    runs = line_dedup.LineRuns(spark)
    runs.add(line_dedup._lines(docs, 10).select("h1", "h2").distinct())
    where = spark.sql(f"DESCRIBE EXTENDED {runs.runs()[0]}").where("col_name = 'Location'").first().data_type
    runs.close()
    assert spark.conf.get("spark.checkpoint.dir") in where
