"""The pipeline's stages on awkward rows: nulls, empty and long texts, ties, repeats, no rows, columns that clash."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import pieces, tiff, token_store
from quarry.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def rows():
    line = "a line that several documents share"
    texts = [None, "", " \n ", "short", line, f"{line}\nown words of the sixth", f"{line}\n{line}", "word " * 3000, "\n".join(f"row {k} of many" for k in range(400))]
    out = [(k + 1, t, "en", "src0" if k % 2 else None, 5) for k, t in enumerate(texts)]
    out += [(3, texts[2], "en", None, 5)] * 2 + [(5, line, "en", None, 7)] + [(None, "text without an id", None, "src1", None), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("awkward")
    spark.createDataFrame(rows(), DOCS).withColumn("ids", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("tokens", F.lit("clash")).write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (4, 1, None), (None, 1, 1), (6, 0, 0)], LABELS).write.parquet(str(base / "labels.parquet"))
    return str(base)


def test_every_stage_takes_awkward_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name != "pieces":
            assert out.columns == corpus_pipeline.COLUMNS, name
        assert set(ids) <= {r[0] for r in rows()}, name
        if name in ("toxicity", "line_dedup", "pieces"):  # nothing here is toxic, and lines go, not documents
            assert len(ids) == len(rows()), name
    lines = {(r.doc_id, r.text) for r in corpus_pipeline.without_repeated_lines(spark, docs, folder).collect()}
    assert (5, "a line that several documents share") in lines and (6, "own words of the sixth") in lines and (7, "") in lines and (1, "") in lines and (None, "text without an id") in lines
    kept = corpus_pipeline.without_near_copies(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 4, 5, 6, 7, 8, 9] and sum(r.doc_id is None for r in kept) == 2


def test_the_pipeline_runs_over_awkward_and_over_no_rows(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder).collect()
    raw = pieces.Pieces(tokenizer_file("piece_bpe_32k.model")).raw
    texts = {pieces.decode(__import__("numpy").array(r.ids), raw) if r.ids else "" for r in out}
    assert all(r.n_tokens == len(r.ids) for r in out) and len({r.doc_id for r in out}) <= 10 and not any("a line that several documents share\na line" in t for t in texts)
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_more_empty_tables_and_clashing_columns(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, ids string, payload string")
    model = tokenizer_file("piece_bpe_32k.model")
    assert pieces.round_trip(none, model).count() == 0 and pieces.encode_documents(none, model).count() == 0
    assert tiff.page_digests(tiff.media_pages(tiff.store_media(none))).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y"), (None, None, None, None)], "doc_id long, text string, ids string, payload string")
    back = [(r.doc_id, r.text) for r in pieces.round_trip(clash, model).collect()]
    assert sorted(back, key=str) == sorted([(1, "a b"), (1, "a b"), (None, "")], key=str)
    assert tiff.page_digests(tiff.media_pages(tiff.store_media(clash))).count() == 3


def test_a_third_of_equal_rows_in_the_store(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"document number {k} of its own") for k in range(200)] + [(7, "the hot row")] * 100, "doc_id long, text string")
    out = token_store.TokenStore.write(frame, str(tmp_path / "s"), tokenizer_file("byte_bpe_50k.json")).document_checksums().orderBy("start").collect()
    assert len(out) == 300 and [r.doc_id for r in out] == sorted(r.doc_id for r in out)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    import pyarrow as pa

    path = tokenizer_file("byte_bpe_50k.json")
    other = json.loads(open(path).read())
    other["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(other))
    encoder = token_store.Encoder(str(tmp_path / "t.json"))
    text = "don't cut, this text  here"
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert not encoder.by_pattern and encoder.encode_many(pa.array([text]))[0] == b"".join(i.to_bytes(2, "little") for i in want)
    small = token_store.Encoder(path, most=1)
    texts = pa.array([f"word{k} and {k * k} more" for k in range(300)])
    assert small.encode_many(texts) == token_store.Encoder(path).encode_many(texts) and small.encode_many(texts) == small.encode_many(texts)


