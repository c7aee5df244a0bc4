"""Merge-dropout by occurrence: hashes belong to a document and a place, and kept states change nothing."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from quarry.llm import pieces
from quarry.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


def test_variety_grows_with_the_documents():
    encoder = pieces.DropoutEncoder(MODEL, 0.1, 11)
    cut = {bytes(x.tobytes()) for x in encoder.encode_many(pa.array(["segmentation"] * 500), list(range(500)))}
    assert len(cut) > 3
    (ids,) = encoder.encode_many(pa.array([" ".join(["segmentation"] * 500)]), [7])
    words, now = set(), []
    for i in ids.tolist():
        if now and encoder.pieces.raw[i].startswith(b" "):
            words.add(tuple(now))
            now = []
        now.append(i)
    assert len(words) > 3


def test_batches_are_cut_as_single_texts_are():
    rng = random.Random(4)
    words = ["segmentation", "don't", "naïve-looking", "日本語", "x" * 400, "a.b,c", "12,345", "word", "theringaoulst" * 5, "e" * 60, "\x00", "é" * 300]
    texts = ["", "a", "\n\n", "a\n b", "  two", "▁ mark", "tail ", "end\n"]
    texts += [rng.choice([" ", "\n", " "]).join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(80)]
    texts.append(" ".join(rng.choices(["a", "is", "word", "don't"], k=66_000)))
    for dropout in (0.0, 0.1, 0.5):
        encoder = pieces.DropoutEncoder(MODEL, dropout, 5)
        single = pieces.DropoutEncoder(MODEL, dropout, 5)
        got = encoder.encode_many(pa.array(texts), [k - 3 for k in range(len(texts))])
        assert [x.tobytes() for x in got] == [single.encode(t, k - 3) for k, t in enumerate(texts)]
        assert [pieces.decode(np.array(x), encoder.pieces.raw) if len(x) else "" for x in got] == texts


def brute(encoder, symbols, base):
    """The method word by word: of all neighbours that make a piece the best and leftmost comes up; skipped ones stay apart."""
    p = encoder.pieces
    live, at, skipped = list(symbols), list(range(len(symbols))), set()
    while True:
        found = [(p.rank[live[k] + live[k + 1]], k) for k in range(len(live) - 1) if live[k] + live[k + 1] in p.rank and (at[k], live[k] + live[k + 1]) not in skipped]
        if not found:
            return [p.ids[x] for x in live]
        m, k = min(found)
        if pieces._skipped(base, at[k], m, encoder.limit):
            skipped.add((at[k], live[k] + live[k + 1]))
            continue
        live[k] += live.pop(k + 1)
        del at[k + 1]


def test_agendas_equal_brute_force():
    rng = random.Random(9)
    for dropout in (0.0, 0.1, 0.4):
        encoder = pieces.DropoutEncoder(MODEL, dropout, 3)
        for n in (1, 2, 3, 7, 12, 32):
            words = [pieces.MARK + "".join(rng.choices("theringaoulstd", k=n - 1)) for _ in range(200)]
            base = np.array([rng.getrandbits(64) for _ in words], np.uint64)
            rows = encoder.table.chars[np.array([[ord(c) for c in w] for w in words])]
            got = [r[r >= 0].tolist() for r in encoder.table.agenda(rows, base, encoder.limit)]
            assert got == [brute(encoder, w, int(b)) for w, b in zip(words, base.tolist(), strict=True)]


def test_skips_have_the_asked_share():
    encoder = pieces.DropoutEncoder(MODEL, 0.1, 11)
    base = np.array([pieces._hash(11, doc, place) for doc in range(200) for place in range(50)], np.uint64)
    keys = [np.uint64(pieces._key(at, merged)) for at in range(4) for merged in (5, 900, 30_000)]
    assert all(abs(np.mean(pieces._low(base, k, encoder.limit)) - 0.1) < 0.01 for k in keys)
