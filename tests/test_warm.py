"""The stored index: commits, repeats, killed and rival writers, compaction, and searches that stop early against plain sums."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.functions.records import VERSIONS
from quarry.operators import warm as W
from quarry.operators.commits import CommitLog, Conflict

SCHEMA = "listing_key long, canonical_url string, content_digest string, availability string, first_seen_at timestamp, updated_at timestamp, title string, text string, " + ", ".join(f"{v} string" for v in VERSIONS)


def listings(spark, rows, policy="p1"):
    """rows: (key, title, text)."""
    from datetime import datetime

    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(k, f"https://x.example/{k}", "d", "LIVE", at, at, t, x, *["v"] * (len(VERSIONS) - 1), policy) for k, t, x in rows], SCHEMA)


FIELDS = {"title": "title", "text": "text"}


def catalogue(n, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    return [(k, rng.choice(words), " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(40)], k=rng.randint(0, 60)))) for k in range(n)]


def plain(rows, terms, limit):
    scores = Counter()
    for k, title, text in rows:
        n = sum(w in terms for w in f"{title} {text}".split())
        if n:
            scores[k] = n
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:limit]


def found(frame):
    return [(r.listing_key, r.term_score) for r in frame.collect()]


@pytest.fixture
def index(spark, tmp_path):
    return W.WarmIndex(spark, f"{tmp_path}/index")


@pytest.mark.parametrize("block", [1, 4, 512])
def test_searches_that_stop_early_equal_plain_sums(spark, index, block):
    rows = catalogue(300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block)  # a block ends with its batch
    try:
        index.put(listings(spark, rows), FIELDS, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for terms in (["word0"], ["word0", "word39"], ["word1", "word2", "word3", "none"], ["none"]):
        for limit in (1, 7, 50, 1000):
            assert found(index.search(terms, limit)) == plain(rows, terms, limit)
    asked = spark.createDataFrame([(q, t) for q, ts in enumerate((["word0"], ["word5", "word30"], ["word39", "word0", "word0"])) for t in ts], "query_id long, term string")
    got = defaultdict(list)
    for r in index.search_many(asked, 9).collect():
        got[r.query_id].append((r.listing_key, r.term_score))
    for q, ts in enumerate((["word0"], ["word5", "word30"], ["word39", "word0"])):
        assert sorted(got[q], key=lambda x: (-x[1], x[0])) == plain(rows, ts, 9)


def test_blocks_below_the_bound_are_not_read(spark, index):
    rows = [(k, "", "hot " * (50 if k < 5 else 1)) for k in range(3000)]
    index.put(listings(spark, rows), FIELDS, 1)
    asked = spark.createDataFrame([(0, "hot")], "query_id long, term string")
    entries = index._live()
    blocks = index._read("postings", entries)
    cut = index._bounds(blocks, asked, 5, entries).first().cut
    assert cut == 50 and blocks.where(F.col("most") >= cut).count() == 1 < blocks.count()
    assert found(index.search(["hot"], 5)) == [(k, 50) for k in range(5)]


def test_a_repeated_put_changes_nothing(spark, index):
    rows = catalogue(60)
    assert index.put(listings(spark, rows), FIELDS, 1)
    before = found(index.search(["word0", "word1"]))
    assert not index.put(listings(spark, rows), FIELDS, 1)
    assert found(index.search(["word0", "word1"])) == before == plain(rows, ["word0", "word1"], 50)
    assert index.put(listings(spark, rows), FIELDS, 2)
    assert found(index.search(["word0", "word1"])) == before and index.count().first().n == 60


def test_a_put_killed_between_tables_is_not_seen(spark, index, monkeypatch):
    rows = catalogue(40)
    index.put(listings(spark, rows), FIELDS, 1)
    before = found(index.search(["word0"]))
    whole = W.WarmIndex._write

    def broken(self, name, *rest):
        if name == "descriptors":
            raise RuntimeError("lost")
        return whole(self, name, *rest)

    monkeypatch.setattr(W.WarmIndex, "_write", broken)
    with pytest.raises(RuntimeError):
        index.put(listings(spark, rows), FIELDS, 2)
    monkeypatch.undo()
    assert found(index.search(["word0"])) == before
    assert index.put(listings(spark, rows), FIELDS, 2) and found(index.search(["word0"])) == before
    assert len(index.vacuum()) == 1 and found(index.search(["word0"])) == before


def test_of_two_writers_of_a_batch_one_is_refused(spark, index, tmp_path):
    rows = catalogue(20)
    index.put(listings(spark, rows), FIELDS, 1, token="a")
    with pytest.raises(Conflict):
        index.put(listings(spark, rows[:5]), FIELDS, 1, token="b")
    assert not index.put(listings(spark, rows[:5]), FIELDS, 1, token="a") and index.count().first().n == 20
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.put(1, {"x": 1}) and not log.put(1, {"x": 2}) and log.entries() == [{"x": 1, "version": 1}]


def test_the_highest_batch_lives_whichever_came_last(spark, index):
    new, old = [(1, "", "fresh fresh"), (2, "", "fresh")], [(1, "", "stale"), (3, "", "stale")]
    index.put(listings(spark, new), FIELDS, 5)
    index.put(listings(spark, old), FIELDS, 4)
    assert found(index.search(["stale"])) == [(3, 1)] and found(index.search(["fresh"])) == [(1, 2), (2, 1)]
    assert index.listings().count() == 3


def test_versions_are_apart(spark, index):
    index.put(listings(spark, [(1, "", "red red"), (2, "", "red")], "p1").unionByName(listings(spark, [(3, "", "red red red")], "p2")), FIELDS, 1)
    own = dict.fromkeys(VERSIONS, "v") | {VERSIONS[-1]: "p1"}
    assert found(index.search(["red"], versions=own)) == [(1, 2), (2, 1)] and found(index.search(["red"])) == [(3, 3), (1, 2), (2, 1)]
    assert found(index.search(["red"], versions=own | {VERSIONS[-1]: "p3"})) == []


def test_compaction_keeps_results_and_drops_files(spark, index):
    rows = catalogue(80)
    index.put(listings(spark, rows), FIELDS, 1)
    newer = [(k, t, x + " word0") for k, t, x in rows[:30]]
    index.put(listings(spark, newer), FIELDS, 2)
    now = newer + rows[30:]
    terms = ["word0", "word7"]
    assert found(index.search(terms)) == plain(now, terms, 50)
    assert index.compact() and found(index.search(terms)) == plain(now, terms, 50)
    assert len(index.vacuum()) == 2 and len(index._live()) == 1
    assert found(index.search(terms)) == plain(now, terms, 50) and index.count().first().n == 80
    assert not index.put(listings(spark, rows), FIELDS, 1)
    last = [(0, "", "word0 " * 99)]
    assert index.put(listings(spark, last), FIELDS, 3) and found(index.search(["word0"], 1)) == [(0, 99)]
    assert index.compact() and found(index.search(terms, 1)) == [(0, 99)]
    fields = {(r.field, r.tf) for r in index.postings(["word0"]).where("listing_key = 0").collect()}
    assert fields == {("text", 99)}


def test_empty_index_and_null_text(spark, index):
    assert found(index.search(["x"])) == [] and not index.compact() and index.listings().count() == 0
    index.put(listings(spark, [(1, None, None), (2, "", "")]), FIELDS, 1)
    assert found(index.search(["x"])) == [] and index.count().first().n == 2 and index.compact()


def test_a_put_moves_terms_with_their_listings_and_not_occurrences(spark):
    texts = spark.createDataFrame([(k, 7, f"boots boots 2024 only{k}") for k in range(200)], "listing_key long, tag long, t0 string").coalesce(1)
    rows = texts.mapInArrow(W._counted(1, True), W.COUNTED).where("term IS NOT NULL").collect()
    assert len(rows) == 203 and {(r.term, r.tf, len(r["keys"])) for r in rows if not r.term.startswith("only")} == {("boots", 2, 200), ("2024", 1, 200), ("24", 1, 200)}


def test_rows_of_one_listing_count_together_field_by_field(spark, index):
    index.put(listings(spark, [(1, "red", "red 24 of"), (1, "", "red. Mark this as authentic red"), (2, "2024", "İn Key")]), FIELDS, 1)
    assert found(index.search(["red"])) == [(1, 3)]
    want = {(1, "title", "red", 1), (1, "text", "red", 2), (1, "text", "24", 1), (1, "text", "2024", 1), (2, "title", "2024", 1), (2, "title", "24", 1), (2, "text", "key", 1)}
    assert {tuple(r) for r in index.postings().collect()} == want
    assert index.compact() and {tuple(r) for r in index.postings().collect()} == want
    each = {r.listing_key: r.descriptor for r in index.descriptors().collect()}
    assert sorted(round(x * x * 11) for x in each[1] if x) in ([1, 1, 9], [4, 9], [1, 16]) and len(each[1]) == 64


@pytest.mark.parametrize("few", [1, 50_000])
def test_many_searches_read_the_postings_once(spark, index, monkeypatch, few):
    """What is asked for is written and read back, so that nothing after it goes over all postings; terms are broadcast or meet in a shuffle."""
    monkeypatch.setattr(W, "FEW", few)
    rows = catalogue(120)
    index.put(listings(spark, rows), FIELDS, 1)
    index.put(listings(spark, rows[:40]), FIELDS, 2)
    asked = spark.createDataFrame([(0, "word0"), (1, "word3"), (1, "word17"), (2, "none")], "query_id long, term string")
    hits = index.search_many(asked, 9)
    assert not [f for f in hits.inputFiles() if "/postings/" in f]
    for q, terms in enumerate((["word0"], ["word3", "word17"], ["none"])):
        assert sorted(found(hits.where(F.col("query_id") == q)), key=lambda x: (-x[1], x[0])) == plain(rows, terms, 9)
