"""TIFF, token store, pieces, top-k, mixing and the pipeline: round trips and brute force."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import mixing, pieces, ranges, tiff, token_store, topk
from quarry.llm.queries import tokenizer_file

TEXTS = [None, "", " ", "  two  spaces ", "a\n b\n\n c\t\td", "▁ the mark ▁▁ itself", "Ünïcode 日本語 🎉 é", "x" * 3000, "word " * 4000, "same text", "same text", "'s it's 12 3,4 -- …", "<|endoftext|> as text", "nbsp\xa0 then space \xa0", "\x01 \x00"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(2 * i + 1, t, "clash", 5, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, page int, start string").repartition(4)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.lists(st.sampled_from([0, 1, 255]), max_size=3000).map(bytes))
def test_codecs_round_trip(data):
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data
    assert tiff.unpackbits(tiff.packbits(data), len(data)) == data


def test_lzw_runs_past_its_table():
    data = random.Random(0).randbytes(60_000)
    assert tiff.unlzw(tiff.lzw(data), len(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("channels", [1, 3])
def test_tiff_pages(compression, predictor, tile, channels):
    rng = np.random.default_rng(1)
    shapes = [(1, 1), (37, 45), (64, 16)]
    made = [rng.integers(0, 5, (*s, channels), dtype=np.uint8) for s in shapes]
    back = list(tiff.read_pages(tiff.write_tiff(made, compression, predictor, 10, tile)))
    assert [(p.page, p.height, p.width, p.channels, p.tiled) for p in back] == [(i, *s, channels, tile is not None) for i, s in enumerate(shapes)]
    assert [p.samples for p in back] == [m.tobytes() for m in made]


def test_big_endian_file():
    body = bytes(range(6))
    tags = [(256, 4, 3), (257, 4, 2), (258, 3, 8 << 16), (259, 3, 1 << 16), (273, 4, 8), (278, 4, 2), (279, 4, 6)]
    data = b"MM" + struct.pack(">HI", 42, 14) + body + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", t, k, 1, v) for t, k, v in tags) + bytes(4)
    (page,) = tiff.read_pages(data)
    assert (page.width, page.height, page.samples) == (3, 2, body)


def test_bad_media(spark):
    good = tiff.write_tiff([np.zeros((4, 4, 1), np.uint8)] * 2)
    loop = bytearray(good)
    link = struct.unpack_from("<I", good, 4)[0]
    n = struct.unpack_from("<H", good, link)[0]
    struct.pack_into("<I", loop, link + 2 + 12 * n, link)
    rows = [(1, 0, None), (2, 0, bytearray(b"no tiff")), (3, 0, bytearray(loop)), (4, 0, bytearray(good[:40])), (5, 0, bytearray(good))]
    out = defaultdict(list)
    for r in tiff.media_pages(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect():
        out[r.doc_id].append((r.page, r.error is None))
    assert 1 not in out and out[2] == [(0, False)] and out[3] == [(0, True), (1, False)] and not out[4][-1][1] and out[5] == [(0, True), (1, True)]


def test_tiff_digests(docs):
    import hashlib

    got = {r.doc_id: r for r in tiff.page_digests(tiff.media_pages(tiff.store_media(docs))).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[2 * i + 1]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    a, b = got[2 * 9 + 1], got[2 * 10 + 1]
    assert (a.media_sha256, a.media_bytes, a.feature) == (b.media_sha256, b.media_bytes, b.feature)


def test_token_store_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    store = token_store.TokenStore.write(docs, str(tmp_path / "store"), tokenizer_file("byte_bpe_50k.json"))
    want, start = {}, 0
    for i, text in enumerate(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[2 * i + 1] = (start, ids)
        start += len(ids)
    got = {r.doc_id: (r.start, list(r.ids)) for r in store.read_documents().collect()}
    assert got == want
    sums = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in store.document_checksums().collect()}
    assert sums == {k: (s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, (s, ids) in want.items()}
    names = [r.key for r in store.chunks.select("key").collect()]
    assert len(names) == len(set(names)) and len(names) < sum(len(token_store.cuts(np.array(i))) for _, i in want.values())


def test_token_store_finds_damage(spark, docs, tmp_path):
    store = token_store.TokenStore.write(docs, str(tmp_path / "store"), tokenizer_file("byte_bpe_50k.json"))
    bad = store.chunks.withColumn("payload", F.concat("payload", F.lit(bytearray(b"\1\0"))))
    bad.write.parquet(str(tmp_path / "bad/rows/kind=chunk"))
    store.recipes.write.parquet(str(tmp_path / "bad/recipes"))
    with pytest.raises(Exception, match="does not match its name"):
        token_store.TokenStore(spark, str(tmp_path / "bad")).document_checksums().collect()


def test_token_store_of_repeats_nulls_and_nothing(spark, tmp_path):
    frame = spark.createDataFrame([(None, "x y"), (3, "abc"), (3, "abc"), (3, "other")], "doc_id long, text string")
    out = token_store.TokenStore.write(frame, str(tmp_path / "a"), tokenizer_file("byte_bpe_50k.json")).document_checksums().collect()
    assert len(out) == 4 and min(out, key=lambda r: r.start).doc_id is None
    ends = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    empty = token_store.TokenStore.write(frame.limit(0), str(tmp_path / "b"), tokenizer_file("byte_bpe_50k.json"))
    assert empty.document_checksums().count() == 0 and empty.read_documents().count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 50000, 20000).astype("<u2")
    b = np.concatenate([rng.integers(0, 50000, 777).astype("<u2"), a])
    chunks = lambda x: {x[s:e].tobytes() for s, e in zip([0, *token_store.cuts(x)], token_store.cuts(x), strict=False)}
    assert len(chunks(a) & chunks(b)) > 0.8 * len(chunks(a))
    sizes = np.diff([0, *token_store.cuts(a)])
    assert sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=400), min_size=1, max_size=6))
def test_combined_checksums(parts):
    assert token_store.combined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def test_pieces_without_dropout_are_the_models(spark, sf_dir):
    import sentencepiece

    model = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    encoder = pieces.DropoutEncoder(model, 0.0)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for t in texts + [t for t in TEXTS if t and "▁" not in t and "\x00" not in t]:
        assert np.frombuffer(encoder.encode(t, 1), np.uint16).tolist() == sp.encode(t), t[:80]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_pieces_decode_losslessly(text):
    encoder = _encoder()
    assert pieces.decode(np.frombuffer(encoder.encode(text, 9), np.uint16), encoder.pieces.raw) == text


def _encoder(kept=[]):  # noqa: B006
    if not kept:
        kept.append(pieces.DropoutEncoder(tokenizer_file("piece_bpe_32k.model"), 0.3, 5))
    return kept[0]


def test_pieces_short_and_long_agendas_agree(monkeypatch):
    p = _encoder().pieces
    rng = random.Random(6)
    for _ in range(200):
        symbols = [pieces.MARK, *rng.choices("theringaoulst", k=rng.randint(1, 30))]
        base, limit = pieces._hash(5, rng.randint(0, 3)), rng.choice([0, 2**62, 2**63])
        assert p._short(symbols, base, limit) == p._long(symbols, base, limit)


def test_pieces_vary_and_repeat(spark, docs):
    model = tokenizer_file("piece_bpe_32k.model")
    a, b, c = (pieces.DropoutEncoder(model, 0.2, s) for s in (1, 1, 2))
    text = "segmentation varies between documents and seeds " * 5
    assert a.encode(text, 3) == b.encode(text, 3) and a.encode(text, 3) != c.encode(text, 3) and a.encode(text, 3) != a.encode(text, 4)
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(docs, model), model).collect()}
    assert back == {2 * i + 1: t or "" for i, t in enumerate(TEXTS)}


def brute_top(rows, k=5):
    out = set()
    for q, a in rows:
        if q % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(b) == len(a))[:k]
        out |= {(q, n + 1, i, -v) for n, (v, i) in enumerate(s)}
    return out


@pytest.mark.parametrize(("dim", "cell", "annulus"), [(4, 64, 16), (16, 8192, 256)])
def test_top_k(spark, monkeypatch, dim, cell, annulus):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "ANNULUS", annulus)
    rng = np.random.default_rng(dim)
    x = rng.normal(0, 1, (700, dim)).astype(np.float32)
    x[100:400] = x[100]  # a third of all rows are one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(900, None), (950, [1.0, None] + [0.0] * (dim - 2)), (1000, [float("nan")] * dim), (1050, [float("inf")] * dim), (1100, [1.0] * (dim + 1)), (1101, [2.0] * (dim + 1)), (None, [1.0] * dim)]
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows + odd], "vec_id long, embedding array<float>, score double")
    got = {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()}
    ints = [(i, [int(np.floor(256 * float(v))) for v in r]) for i, r in rows] + [(1100, [256] * (dim + 1)), (1101, [512] * (dim + 1))]
    assert got == brute_top(ints)


def test_top_k_of_nothing_and_few(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(50, [1.0])], kind), F.col("vec_id") % 50 == 0).count() == 0
    got = topk.top_k(spark.createDataFrame([(50, [1.0]), (50, [1.0]), (1, [-3.0])], kind), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, -768 * 256)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 1000), st.lists(st.tuples(st.floats(0.01, 5), st.integers(0, 300)), min_size=1, max_size=8))
def test_split_budget(budget, children):
    weights, room = [c[0] for c in children], [c[1] for c in children]
    out = mixing.split_budget(budget, weights, room)
    assert sum(out) == min(budget, sum(room)) and all(0 <= a <= b for a, b in zip(out, room, strict=True))
    free = [(a / w) for a, w, r in zip(out, weights, room, strict=True) if a < r - 1]
    assert not free or all(a / w <= min(free) + 2 / min(weights) for a, w, r in zip(out, weights, room, strict=True) if a >= r - 1 and r)


def test_shortage_goes_to_siblings_before_ancestors():
    mix = mixing.Mix({("a",): 0.5, ("b",): 0.5}, max_epochs=1)
    sizes = {("a", "en", "s1"): 10, ("a", "en", "s2"): 500, ("a", "de", "s3"): 500, ("b", "en", "s4"): 1000}
    out = mixing.budgets(sizes, mix, 800)
    assert out == {("a", "en", "s1"): 10, ("a", "en", "s2"): 190, ("a", "de", "s3"): 200, ("b", "en", "s4"): 400}


def brute_mix(rows, given, seed, spark):
    """rows (doc_id, tag, tokens, leaf, hash by epoch): whole epochs, then a prefix in hash order with equal rows together."""
    out = Counter()
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    for leaf, own in by.items():
        size = sum(r[2] for r in own)
        whole, rest = (given[leaf] // size, given[leaf] % size) if size else (0, 0)
        for r in own:
            for e in range(whole):
                out[r[0], e] += 1
        left, keys = rest, defaultdict(list)
        for r in own:
            keys[(r[4][whole] % 2**64, r[0] is not None, r[0] or 0, r[1])].append(r)
        for k in sorted(keys):
            left -= sum(r[2] for r in keys[k])
            if left < 0:
                break
            if rest:
                for r in keys[k]:
                    out[r[0], whole] += 1
    return out


@pytest.mark.parametrize(("share", "epochs", "bin_rows"), [(0.5, 2, 4096), (0.9, 1, 10), (2.5, 4, 7)])
def test_mixing_against_brute_force(spark, monkeypatch, share, epochs, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    rng = random.Random(4)
    made = [(i, " ".join(["w"] * rng.randint(0, 30)) or None, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2"]), "x") for i in range(600)] + [(7, "w w", "en", "s0", "x")] * 3 + [(None, "w", "en", "s1", "x")]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, domain string").repartition(6)
    domain = F.when(F.col("source") == "s0", "crawl").otherwise("rest")
    mix = mixing.Mix({("crawl",): 0.3, ("rest",): 0.7, ("*", "en"): 2.0}, share=share, max_epochs=epochs, seed=3)
    out = Counter((r.doc_id, r.epoch) for r in mixing.mix_sources(docs, mix, domain).collect())
    text = F.coalesce("text", F.lit(""))
    hashes = docs.select("doc_id", F.xxhash64(text).alias("tag"), "text", "lang", "source", *(F.xxhash64(F.lit(3), F.lit(e), "doc_id", F.xxhash64(text)).alias(f"h{e}") for e in range(5))).collect()
    rows = [(r.doc_id, r.tag, len((r.text or "").split()), ("crawl" if r.source == "s0" else "rest", r.lang or "", r.source), [r[f"h{e}"] for e in range(5)]) for r in hashes]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += r[2]
    given_ = mixing.budgets(dict(sizes), mix, int(share * sum(sizes.values())))
    assert out == brute_mix(rows, given_, 3, spark)


def test_mixing_of_nothing(spark):
    kind = "doc_id long, text string, lang string, source string"
    for rows in ([], [(1, None, None, None), (2, "", "en", "s")]):
        assert mixing.mix_sources(spark.createDataFrame(rows, kind), mixing.Mix(), F.lit(None).cast("string")).count() == 0


def test_running_start(spark):
    rows = [(i % 50, i, i % 7) for i in range(500)] + [(None, 1, 5)]
    got = ranges.with_running_start(spark.createDataFrame(rows, "k long, t long, n long").repartition(7), ["k", "t"], "n").collect()
    at = 0
    for r in sorted(got, key=lambda r: (r.k is not None, r.k or 0, r.t)):
        assert r.start == at
        at += r.n


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "mixing", "pieces"]
    ids, before = {r.doc_id for r in docs.collect()}, None
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "pieces":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        before, docs = docs, spark.createDataFrame(out.toArrow()) if name != "pieces" else out
        now = {r.doc_id for r in docs.collect()}
        assert now <= ids and now
        ids = now
    assert before is not None and {r.doc_id for r in P.run(spark, sf_dir).collect()} == ids
    row = docs.first()
    raw = pieces.Pieces(tokenizer_file("piece_bpe_32k.model")).raw
    text = before.where(F.col("doc_id") == row.doc_id).first().text
    assert pieces.decode(np.array(row.ids), raw) == text and row.n_tokens == len(row.ids)
