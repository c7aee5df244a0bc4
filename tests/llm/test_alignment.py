"""Cross-tokenizer alignment against byte ranges compared pair by pair over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment as L
from quarry.llm.queries import QUERIES, tokenizer_file

SCHEMA = "doc_id long, text string, n_a string, groups int"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def corpus():
    rng = random.Random(4)
    words = ["the", "thing", "über", "naïve", "l'été", "don't", "x=1;", "日本語", "🙂", "ſ", "internationalisation", "1234567", " ", "é", "<s>", "<|endoftext|>", "..."]
    gaps = [" ", " ", " ", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\r\n", "　 ", "\x1c "]
    texts = [None, "", " ", "\n", "a", " a", "\na", "a\n", "a ▁b", "▁", "\x00", "x\x01 y", "<unk> <0x0A> <|endoftext|>", "é" * 40, "ab" * 3000, "\u0085 x", "a᠎  b"]
    texts += ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(rng.choices(words, k=4000))] + [texts[-1]] * 3
    return [(i * 7 + 1, t, "clash", 3) for i, t in enumerate(texts)] + [(None, "null id", "", 0), (8, "again 8", "", 0)]


def brute(texts):
    letters = L.byte_letters()
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    per = []
    for t in texts:
        a_ids = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b_ids = sp.encode(t) if t else []
        a = [bytes(letters[c] for c in tok.id_to_token(i)) for i in a_ids]
        b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not t or b"".join(a) != (" " + t).encode() or b"".join(b) != (" " + t).encode():
            per.append(([], [], [], "", 0))
            continue
        ends = lambda x: [sum(map(len, x[: k + 1])) for k in range(len(x))] if len(x) < 400 else __import__("itertools").accumulate(map(len, x))
        ea, eb = list(ends(a)), list(ends(b))
        both = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for e in both:
            x, y = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append(f"{','.join(map(str, a_ids[i:x]))}|{','.join(map(str, b_ids[j:y]))}")
            i, j = x, y
        links, first = [], 0
        for k, e in enumerate(ea):
            s = e - len(a[k])
            while eb[first] <= s:
                first += 1
            m = first
            while m < len(b) and eb[m] - len(b[m]) < e:
                links.append((a_ids[k], b_ids[m]))
                m += 1
        per.append((a_ids, b_ids, links, ";".join(groups), len(both)))
    count = Counter(p for *_, links, _, _ in per for p in set(links))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    return [(len(a), len(b), n, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), g) for a, b, links, g, n in per]


@pytest.fixture(scope="module")
def want():
    return sorted(zip([r[0] or -1 for r in corpus()], brute([r[1] for r in corpus()]), strict=True))


@pytest.mark.parametrize("block", [1, 5000, 1 << 23])
def test_against_byte_ranges(spark, want, block):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    got = sorted((r.doc_id or -1, tuple(r)[1:]) for r in L.align(docs, A, B, as_text=True, block_chars=block).collect())
    assert got == want
    assert any(n == 0 and t for (_, (n, *_)), t in zip(want, sorted(corpus(), key=lambda r: r[0] or -1), strict=True))


def test_query_on_its_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    rows = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_alignment"](spark, sf_dir).collect()}
    for d, w in zip(docs, brute([d.text or "" for d in docs]), strict=True):
        assert rows[d.doc_id] == (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")


def test_slices_and_forgetting(monkeypatch):
    text = " ".join(f"word{i * i}\nnext" for i in range(3000)) + " " + "y" * 500
    whole = L.Aligner(L.ByteSide(A), L.PieceSide(B))
    units = [u for part in whole.slices(" " + text) for u in part]
    assert "".join(units) == " " + text
    monkeypatch.setattr(L, "SLICE", 100)
    cut = L.Aligner(L.ByteSide(A), L.PieceSide(B), most=10_000)
    assert [u for part in cut.slices(" " + text) for u in part] == units
    one, two = L._Block(True), L._Block(True)
    one.add(whole, [(1, text)])
    two.add(cut, [(1, text)])
    for a, b in zip(one.row(0)[3:], two.row(0)[3:], strict=True):
        assert a == b


def test_a_tokenizer_that_does_not_break_goes_whole():
    side = L.ByteSide(A)
    side.breaks = False
    aligner = L.Aligner(side, L.PieceSide(B))
    assert list(aligner.slices(" a b\nc")) == [[" a b\nc"]]
    assert aligner.learn([" a b\nc"])[" a b\nc"][0] == ";".join(x[0] for x in aligner.learn([" a", " b", "\nc"]).values())


def test_empty_table(spark):
    assert L.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
