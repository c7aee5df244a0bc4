"""Operators on small frames: index, clusters, ranks, metrics, events, sources, sinks, streams."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import records
from quarry.operators import cluster, events, index, metrics, ranking, warm
from quarry.sources import feeds, sinks
from quarry.streaming import log


def test_hybrid_keeps_both_lanes(spark):
    text = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "b", 4)], "query_id int, listing_key string, term_score long")
    vec = spark.createDataFrame([(1, "b", 0.9), (1, "c", 0.5)], "query_id int, listing_key string, descriptor_score double")
    assert sorted(tuple(r) for r in index.hybrid(text, vec).collect()) == [(1, "a", 3, 0.0), (1, "b", 1, 0.9), (1, "c", 0, 0.5), (2, "b", 4, 0.0)]


def test_upserts(spark):
    kind = "k string, v int, first_seen int, at int"
    old, new = spark.createDataFrame([("a", 1, 1, 1), ("b", 1, 1, 1)], kind), spark.createDataFrame([("a", 2, 5, 5), ("c", 3, 5, 5)], kind)
    assert sorted(tuple(r) for r in index.upsert(old, new, ["k"], "at", ("first_seen",)).collect()) == [("a", 2, 1, 5), ("b", 1, 1, 1), ("c", 3, 5, 5)]
    assert sorted(r.k for r in index.insert_once(old, new.unionByName(new), ["k"]).collect()) == ["a", "b", "c"]
    fit, refused = index.refused(old.withColumn("t", F.when(F.col("k") == "a", "<script>").otherwise("ok")), ["k", "t"])
    assert [r.k for r in fit.collect()] == ["b"] and [r.k for r in refused.collect()] == ["a"]


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_near_titles_equal_all_pairs(spark, threshold):
    rng = random.Random(2)
    words = "red boot bag coat silk wool ring 靴 バッグ".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(120)]
    sets = {i: {w.lower() for w in t.split()} for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    pairs, members = cluster.near_title_pairs(spark.createDataFrame(rows, "id long, t string"), "id", "t", threshold)
    head = {r.id: r.head for r in members.collect()}
    assert set(head) == {i for i in sets if sets[i]} and all(sets[i] == sets[h] and h <= i for i, h in head.items())
    linked = {(r.a, r.b) for r in pairs.collect()}
    got = {(a, b) for a, b in itertools.combinations(sorted(head), 2) if head[a] == head[b] or tuple(sorted((head[a], head[b]))) in linked}
    assert got == want


def test_titles_that_a_third_of_rows_share_cost_no_pairs(spark):
    rows = [(i, None if i % 2 else str(i % 5), "one hot title of all") for i in range(1000)] + [(i, None, f"own title {i} {i * 7}") for i in range(1000, 3000)]
    frame = spark.createDataFrame(rows, "id long, listing string, title string")
    assert cluster.near_title_pairs(frame, "id", "title")[0].count() == 0
    assert cluster.title_edges(frame).count() < 3 * len(rows)


def test_clusters_respect_known_ids(spark):
    rows = [(1, "x:1", None, "1", "red boot one two three"), (2, "x:2", None, "2", "red boot one two three"), (3, "u:3", "f", None, "green"), (4, "u:4", "f", None, "blue"), (5, "u:4", None, None, "black")]
    out = cluster.cluster_listings(spark.createDataFrame(rows, "id long, key string, family string, listing string, title string"))
    assert {r.id: r.cluster for r in out.collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}


def test_greedy_distinct(spark):
    rows = [(1, 1, "red boot"), (1, 2, "Red  boot"), (1, 3, "blue boot"), (2, 1, ""), (2, 2, '"')]
    out = cluster.greedy_distinct(spark.createDataFrame(rows, "g int, n int, t string"), "g", "t", "n")
    assert sorted((r.g, r.n) for r in out.collect()) == [(1, 1), (1, 3), (2, 1)]


def test_diversify_and_cascade(spark):
    rows = spark.createDataFrame([("t", "f", 1), ("t", "f", 2), ("t", "g", 3)], "tab string, fam string, rank int")
    assert [(r["rank"], r.place) for r in ranking.diversify(rows, "tab", "fam").orderBy("place").collect()] == [(1, 1), (3, 2), (2, 3)]
    stages = ranking.cascade(spark.range(600), F.col("id"), "id").groupBy("stage").count().collect()
    assert {r.stage: r["count"] for r in stages} == {"deep": 10, "deliberative": 5, "parts": 35, "download": 50, "normalised": 150, "broad": 250}


def test_rounds_stop_at_the_first_failure(spark):
    rows = [("s", r, g, "f", 1, str(i)) for i, (r, g) in enumerate([(0, 0.01), (2, 0.07), (3, 0.01), (4, 0.9)])]
    q = spark.createDataFrame(rows, "search string, round int, gain double, family string, cost int, text string")
    assert sorted(r["round"] for r in ranking.enabled_rounds(q, "search").collect()) == [0, 2]
    assert [r.text for r in ranking.select_queries(q, "search").orderBy("position").collect()] == ["1", "0"]


def test_language_repair(spark):
    rows = [("s", "en", 0.9, "a", 1.0), ("s", "en", 0.5, "b", 2.0), ("s", "ja", 0.2, "c", None), ("s", "fr", 0.1, "d", None)]
    q = spark.createDataFrame(rows, "search string, language string, gain double, text string, position double")
    assert sorted(r.text for r in ranking.language_repair(q, "search", ["en", "ja"], in_all=2).collect()) == ["a", "c"]


def test_metrics(spark):
    pairs = spark.createDataFrame([(0.57, True), (0.57, False), (1.0, True), (0.4, False), (None, True)], "score double, ok boolean")
    sweep = {r.threshold: (r.tpr, r.fpr) for r in metrics.threshold_sweep(pairs, "score", "ok").collect()}
    assert sweep[40] == (1.0, 1.0) and sweep[57] == (1.0, 0.5) and sweep[58] == (0.5, 0.0) and len(sweep) == 60
    assert metrics.choose_threshold(metrics.threshold_sweep(pairs, "score", "ok")).first().threshold == 58
    bins = {r.bin: r.n for r in metrics.calibration_bins(pairs, "score", "ok").collect()}
    assert len(bins) == 10 and bins[9] == 1 and bins[5] == 2 and bins[0] == 0
    rows = spark.createDataFrame([("a", "a"), ("a", "b")], "t string, p string")
    assert {r.label: (r.precision, r.recall) for r in metrics.precision_recall(rows, "t", "p", ["a", "b"]).collect()} == {"a": (1.0, 0.5), "b": (0.0, None)}


def test_events(spark):
    t = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    rows = [("u", i, i - 1 if i else None, t(i), o) for i, o in enumerate(["bad", "bad", "ok", "bad", "bad", "bad"])]
    e = spark.createDataFrame(rows, "u string, id long, before long, ts timestamp, o string")
    assert events.chain_ok(e, "u", "id", "before", ["ts"]).first().ok
    assert not events.chain_ok(e.where("id <> 2"), "u", "id", "before", ["ts"]).first().ok
    streaks = events.failure_streaks(e, "u", ["ts", "id"], F.col("o") == "bad")
    assert [r.streak for r in streaks.orderBy("id").collect()] == [1, 2, 0, 1, 2, 3]
    assert events.breaker(streaks, "u", ["ts", "id"], "ts", F.lit(False)).first().opened_until == t(5) + dt.timedelta(hours=4)
    assert [r.n for r in events.numbered(e, "u", ["ts"], after=4).collect()] == [5, 6]
    used = events.budget(e.withColumn("one", F.lit(1)), "u", ["ts"], "one", 3).orderBy("ts").collect()
    assert [r.refused for r in used] == [False] * 3 + [True] * 3
    sealed = records.sealed(e, ["id", "o"])
    assert records.broken(sealed, ["id", "o"]).count() == 0 and records.broken(sealed.withColumn("o", F.lit("x")), ["id", "o"]).count() == 6
    moves = spark.createDataFrame([("d", 1, "incoming"), ("d", 2, "verified"), ("d", 3, "incoming")], "d string, n int, zone string")
    assert [(r.came_from, r.zone) for r in events.illegal_moves(moves, "d", "zone", ["n"], [tuple(m.split(">")) for m in records.MOVES]).collect()] == [("verified", "incoming")]


def test_frontier(spark):
    now = dt.datetime(2024, 1, 1)
    rows = [("a", "QUEUED", 1, 0.5, now), ("a", "QUEUED", 1, 0.9, now), ("b", "QUEUED", 4, 0.9, now), ("c", "QUEUED", 0, 0.7, now), ("c", "DONE", 0, 0.7, now)]
    f = spark.createDataFrame(rows, "work_key string, state string, depth int, priority double, created_at timestamp")
    assert [(r.work_key, r.priority) for r in events.frontier_batch(f, 9).collect()] == [("a", 0.9)]


def test_feeds(spark, tmp_path):
    feed = {"products": [{"title": "Boot", "handle": "boot", "vendor": "V", "images": [{"src": "i"}], "variants": [{"price": "9.5", "available": True}]}, {"title": "Bare", "handle": "bare"}]}
    rows = feeds.feed_members(spark.createDataFrame([("https://x.example", json.dumps(feed)), ("https://y.example", "nonsense")], "o string, b string"), "b", "o").collect()
    assert [(r.url, r.price, r.available) for r in rows] == [("https://x.example/products/boot", "9.5", True), ("https://x.example/products/bare", None, False)]
    pages = spark.createDataFrame([("https://x.example/", '<a href="/products/a?utm_source=z">'), ("https://x.example/m.xml", "<urlset><loc> https://x.example/products/b </loc><loc>https://z.example/products/c</loc>")], "u string, b string")
    found = feeds.members(pages, "b", "u", ["/products/"], ["x.example"])
    assert sorted(r.member for r in found.collect()) == ["https://x.example/products/a", "https://x.example/products/b"]
    seen = spark.createDataFrame([("https://x.example/products/b",)], "member string")
    out = feeds.expand(found, [["products"]], seen, 5, F.lit(1)).collect()
    assert {r.member[-1]: r.drop_reason for r in out} == {"a": None, "b": "already_seen"}
    (tmp_path / "o.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t96.5\tGUIDI\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n")
    assert [(r.text, r.confidence) for r in feeds.adapter("ocr")(spark, str(tmp_path / "o.tsv")).collect()] == [("GUIDI", 0.965)]
    with pytest.raises(KeyError):
        feeds.adapter("none")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "s string, v int")
    path = str(tmp_path / "t")
    sinks.append(rows, path, "s")
    sinks.overwrite_partitions(spark.createDataFrame([("b", 3)], "s string, v int"), path, "s")
    assert sorted((r.s, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]
    assert sinks.purge(spark, path, "s", "a") and not sinks.purge(spark, path, "s", "zz")
    assert [r.s for r in spark.read.parquet(path).collect()] == ["b"]
    for _ in range(2):
        sinks.put_objects(spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),)], "content binary"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    m = spark.sql("SELECT map('a', 1, 'b', 2) AS o, map('b', 3) AS n").select(sinks.merged_maps("o", "n").alias("m")).first().m
    assert m == {"a": 1, "b": 3}


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("u", i, t + dt.timedelta(minutes=i), o, float(i)) for i, o in enumerate(["failed", "failed", "failed", "ok", "blocked"])]
    kind = "user string, seq long, ts timestamp, outcome string, value double"
    src = str(tmp_path / "src")
    frame = spark.createDataFrame(rows, kind)
    frame.where("seq < 2").coalesce(1).write.parquet(src)
    read = lambda: log.read(spark, src, frame.schema)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    log.append_log(read(), out, mark).awaitTermination()
    frame.where("seq >= 2").coalesce(1).write.mode("append").parquet(src)
    log.append_log(read(), out, mark).awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3, 4]
    q = log.append_log(log.breakers(read(), "user", "ts"), str(tmp_path / "b"), str(tmp_path / "bm"))
    q.awaitTermination()
    assert [r.state for r in spark.read.parquet(str(tmp_path / "b")).orderBy("ts").collect()] == ["closed", "closed", "open", "closed", "open"]
    log.append_log(log.token_buckets(read(), "user", "ts", 1 / 120, 2.0), str(tmp_path / "k"), str(tmp_path / "km")).awaitTermination()
    assert [r.allowed for r in spark.read.parquet(str(tmp_path / "k")).orderBy("ts").collect()] == [True, True, True, False, True]
    log.upsert_log(read(), str(tmp_path / "u"), str(tmp_path / "um"), "user", "seq").awaitTermination()
    spark.createDataFrame([("u", 9, t, "ok", 1.0), ("v", 1, t, "ok", 1.0)], kind).coalesce(1).write.mode("append").parquet(src)
    log.upsert_log(read(), str(tmp_path / "u"), str(tmp_path / "um"), "user", "seq").awaitTermination()
    assert sorted((r.user, r.seq) for r in spark.read.parquet(str(tmp_path / "u")).collect()) == [("u", 9), ("v", 1)]
    log.append_log(log.windowed(read(), "ts", "2 minutes", "1 minute", "user", "value"), str(tmp_path / "w"), str(tmp_path / "wm")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "w")).count() >= 1


def test_states_are_the_twenty_five():
    moves = events.legal_moves()
    assert len(events.STATES) == 25 and sum(not f for f in events.STATES.values()) == 5 and len(moves) == len(set(moves))
    assert ("CREATED", "BLOCKED") not in moves and ("REPLANNING", "PARTIAL") not in moves and ("RANKING", "PARTIAL") in moves and {t for s, t in moves if s == "CREATED"} == {"VALIDATING_INPUT", "CANCELLED", "FAILED"}


def test_budget_holds_until_committed_or_released(spark):
    rows = [(1, "reserve", 1, {"pages": 3.0}), (2, "reserve", 2, {"pages": 2.0}), (3, "reserve", 3, {"pages": 1.0}), (4, "release", 1, None), (5, "release", 1, None), (6, "reserve", 4, {"pages": 3.0, "bytes": 9.0}), (7, "commit", 2, None), (8, "release", 2, None), (9, "reserve", 5, {"bytes": 1e9})]
    moves = spark.createDataFrame([("c", *r) for r in rows], "campaign string, seq int, move string, reservation int, amounts map<string, double>")
    got = [r.verdict for r in events.budget_ledger(moves, {"pages": 5.0}).orderBy("seq").collect()]
    assert got == ["ok", "ok", "pages", "ok", "closed", "ok", "ok", "closed", "ok"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exploration_never_takes_what_is_held(spark, seed):
    rng = random.Random(seed)
    sources, pages = ["a", "b", "c"], 9
    rows = [("c", n, rng.choice(sources), rng.random() < 0.05) for n in range(40)]
    got = {r.seq: r.taken for r in events.exploration(spark.createDataFrame(rows, "campaign string, seq int, source string, finished boolean"), sources, pages).collect()}
    taken, done = dict.fromkeys(sources, 0), set()
    for _, n, s, end in rows:
        if end:
            done.add(s)
            want = False
        else:
            left, held = pages - sum(taken.values()), sum(max(0, 2 - taken[o]) for o in sources if o != s and o not in done)
            want = left > 0 and (taken[s] < 2 or left > held)
            taken[s] += want
        assert got[n] == want
    assert sum(taken.values()) <= pages


def test_paces(spark):
    calls = spark.createDataFrame([("h", 0.0, 60), ("h", 0.5, 60), ("h", 1.2, 60), ("h", 1.3, 100)], "host string, at double, bytes long")
    assert [round(r.wait, 6) for r in events.bandwidth(calls, 100).orderBy("at").collect()] == [0.0, 0.2, 0.0, 0.6]
    assert [round(r.wait, 6) for r in events.token_bucket(calls, 1.0, 2.0).orderBy("at").collect()] == [1.0, 1.5, 1.8, 2.7]


@pytest.mark.parametrize("many", [True, False])
def test_vector_blocks_equal_all_pairs(spark, monkeypatch, many):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (90, 8)), 3)
    x[10:50] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [1.0, 2.0]), (202, [0.0] * 8)]
    frame = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    got = {(r.query_id, r.listing_key, round(r.descriptor_score, 6)) for r in index.vector_search(frame.where("k % 9 = 0"), frame, "k", "v", limit=5).collect()}
    want = set()
    for i, a in rows:
        if i % 9 or a is None or len(a) != 8:
            continue
        s = [(-round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if any(a) and any(b) else 0.0, 6), j) for j, b in rows if b is not None and len(b) == 8]
        want |= {(i, j, -c + 0.0) for c, j in sorted(p for p in s if p[0] <= 0)[:5]}
    assert got == want
    if many:
        monkeypatch.setattr(index, "cosine_blocks", lambda *a, f=index.cosine_blocks, **k: f(*a, **k | {"rows": 7, "most_queries": 1}))
        again = index.vector_search(frame.where("k % 9 = 0"), frame, "k", "v", limit=5)
        assert {(r.query_id, r.listing_key, round(r.descriptor_score, 6)) for r in again.collect()} == want


def test_warm_index_pushes_terms_into_the_scan(spark, tmp_path):
    w = warm.WarmIndex(spark, str(tmp_path / "w"))
    assert w.count().first().n == 0
    t = dt.datetime(2024, 1, 1)
    row = lambda k, text: (k, f"u{k}", "d", "LIVE", t, t, text, "a", "m", "p", "s", "p")
    kind = "listing_key long, canonical_url string, content_digest string, availability string, first_seen_at timestamp, updated_at timestamp, text string, adapter_version string, model_version string, parameters string, schema_version string, policy_version string"
    w.put(spark.createDataFrame([row(1, "red boot"), row(2, "blue boot boot")], kind), {"text": "text"}, 1)
    w.put(spark.createDataFrame([row(1, "green coat")], kind), {"text": "text"}, 2)
    assert [(r.listing_key, r.term_score) for r in w.search(["boot", "red"]).collect()] == [(2, 2)]
    plan = w.postings(["boot"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [boot])" in plan or "EqualTo(term,boot)" in plan


def test_vector_blocks_are_worked_on_in_strips(spark):
    import pyarrow as pa

    frame = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(100)], "k long, v array<double>").coalesce(1)
    sizes = index.cosine_blocks(frame, frame, "k", "v", lambda b: pa.RecordBatch.from_arrays([pa.array([b.cos.shape[0]])], names=["n"]), "n long", rows=64, strip=8).collect()
    assert max(r.n for r in sizes) == 8 and sum(r.n for r in sizes) == 200


@pytest.mark.parametrize("cut", [{}, {"rows": 7, "most_queries": 1}, {"rows": 64, "strip": 8}])
@pytest.mark.parametrize("odd", [False, True])
def test_every_vector_has_a_rank(spark, tmp_path, monkeypatch, odd, cut):
    """No id but 0 can be divided by 20; equal vectors, equal scores, a label without a partner and vectors without a label; odd: vectors of zeros and of no numbers."""
    import duckdb

    from quarry.plans import evaluation
    from quarry.plans.registry import ORACLE_SQL

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (80, 6)), rng.integers(-1, 2, (60, 6)) + [4.0, 0, 0, 0, 0, 0]])
    x[5:30] = x[5]
    if odd:
        x[[3, 90]], x[40, 2], x[41, 0] = 0.0, np.nan, np.inf
    rows = [(20 * i + i % 19 + 1 if i else 0, v.tolist(), None if i % 31 == 2 else 9 if i == 77 else i * i % 5) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    monkeypatch.setattr(index, "cosine_blocks", lambda *a, f=index.cosine_blocks, **k: f(*a, **k | cut))
    ranks = {tuple(r) for r in evaluation.first_correct(spark, str(tmp_path)).collect()}
    assert ranks == set(con.execute(f"WITH {evaluation.RANKS_SQL} SELECT query, qlabel, rank FROM ranks").fetchall()) and len(ranks) == 140
    if not cut:
        got = evaluation.recall_mrr(spark, str(tmp_path))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(ORACLE_SQL["recall_mrr"]).fetchall()))
