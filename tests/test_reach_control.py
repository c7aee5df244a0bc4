"""Path rules and strategies, campaigns that are cancelled, keyed campaign state, event log and feed formats, the grid of blocks."""

from __future__ import annotations

import json
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import control, index, reach
from quarry.sources import eventsource
from quarry.streaming import campaigns as C

RULES = "source_id string, prefix string, allow boolean"


def test_the_longest_rule_wins(spark):
    rules = spark.createDataFrame([("a", "/p", False), ("a", "/p/1", True), ("a", "/p/1", False), ("a", "/q?x=", False), ("a", "/s*", False), ("b", "/", False), ("a", "", False)], RULES)
    urls = ["https://x/p/2", "https://x/p/1?y", "https://x/q?x=1", "https://x/q", "https://x", "https://x/search#f", "https://x?z"]
    got = {r.url: (r.prefix, r.allowed) for r in reach.ruled(spark.createDataFrame([("a", u) for u in urls], "source_id string, url string"), rules).collect()}
    assert got == {urls[0]: ("/p", False), urls[1]: ("/p/1", True), urls[2]: ("/q?x=", False), urls[3]: (None, True), urls[4]: (None, True), urls[5]: ("/s", False), urls[6]: (None, True)}
    none = reach.ruled(spark.createDataFrame([("c", "https://x/p"), ("b", None)], "source_id string, url string"), rules).collect()
    assert {(r.source_id, r.allowed) for r in none} == {("c", True), ("b", True)}


def test_a_line_for_each_source(spark):
    rows = spark.createDataFrame([(1, "a", "sitemap", "queued", "robots-allowed sitemap", 0), (1, "a", "collection_slug", "queued", "guess", 4), (1, "a", "site_search", "skipped", "no query text", 0)], "query_id long, source_id string, strategy string, status string, reason string, yielded int")
    assert reach.detail(rows).first().detail == "collection_slug: 4; site_search: skipped (no query text); sitemap: 0 (robots-allowed sitemap)"


def slow(spark, seconds):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(0, 8, 1, 8).mapInPandas(wait, "id long")


def test_one_of_two_running_campaigns_is_stopped(spark, tmp_path):
    c = control.Campaigns(spark, f"{tmp_path}/campaigns")
    assert c.run("a", lambda s: s.range(3)) == 1 and c.run("b", lambda s: s.range(4)) == 2
    other = control.Campaigns(spark, f"{tmp_path}/campaigns")

    def stop_and_wait(s):
        other.cancel("a")
        return slow(s, 60)

    began = time.time()
    assert c.run_all({"a": stop_and_wait, "b": lambda s: slow(s, 2)}) == {"a": "CANCELLED", "b": "COMPLETE"}
    assert time.time() - began < 50
    assert sorted(r.id for r in c.result("a").collect()) == [0, 1, 2] and c.result("b").count() == 8
    with pytest.raises(control.Cancelled):
        c.run("a", lambda s: s.range(9))
    assert c.run_all({"d": lambda s: s.range(1).select(F.raise_error(F.lit("x")))}) == {"d": "FAILED"} and c.result("d") is None


def asked(spark, rows):
    return spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(minutes=m), n, t) for k, m, n, t in rows], "search_id string, at timestamp, n long, target string")


PATH = ["VALIDATING_INPUT", "INGESTING_REFERENCES", "COMPLETE", "CALIBRATING_REFERENCES", "CANCELLED", "FAILED"]


def test_a_stopped_campaign_ends_like_one_that_was_not(spark):
    rows = [(k, i, i, t) for k in "ab" for i, t in enumerate(PATH)]
    with C.rocksdb(spark):
        whole = sorted(map(tuple, C.moves(asked(spark, rows)).collect()))
        for cut in (1, 3):
            first = C.moves(asked(spark, [r for r in rows if r[1] < cut]))
            rest = C.moves(asked(spark, [r for r in rows if r[1] >= cut]), C.last_states(first))
            assert sorted(map(tuple, first.unionByName(rest).collect())) == whole
    assert [r[5] for r in whole[:6]] == [None, None, "illegal", None, None, "terminal"]


def test_a_stalled_campaign_ends_by_its_timer(spark, tmp_path):
    schema = "search_id string, at timestamp, n long, target string"
    asked(spark, [("a", 0, 0, PATH[0]), ("b", 0, 0, PATH[0])]).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    asked(spark, [("b", 9 * 60, 1, PATH[1])]).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    asked(spark, [("b", 10 * 60, 2, PATH[3])]).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    out = []
    with C.rocksdb(spark):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = C.moves(rows, stall=timedelta(hours=8)).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    ended = [(r.search_id, r.source, r.target, r.at) for r in out if r.n is None]
    assert ("a", "VALIDATING_INPUT", "PARTIAL", datetime(2024, 1, 1, 8)) in ended and all(e[3] == datetime(2024, 1, 1, 8) for e in ended)


def test_events_by_format(spark, tmp_path):
    eventsource.register(spark)
    at = datetime(2024, 1, 1)
    write = lambda name, ids: pd.DataFrame({"event_id": ids, "ts": [at] * len(ids), "user_id": 1, "event_type": "x", "value": 0.5, "props": None}).astype({"props": "string"}).to_parquet(f"{tmp_path}/log/{name}.parquet", row_group_size=3)
    (tmp_path / "log").mkdir()
    write("1", list(range(10)))
    read = lambda **o: sorted(r.event_id for r in spark.read.format("quarry_events").options(path=f"{tmp_path}/log", **o).load().collect())
    assert read() == list(range(10)) and read(after=4) == [5, 6, 7, 8, 9] and read(after=2, until=4) == [3, 4] and read(after=99) == []

    def stream(checkpoint, **options):
        got = []
        rows = spark.readStream.format("quarry_events").options(path=f"{tmp_path}/log", **options).load()
        rows.writeStream.foreachBatch(lambda df, _: got.extend(r.event_id for r in df.collect())).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return sorted(got)

    cursor = {"cursor": f"{tmp_path}/cursor"}
    assert stream("c", after=6, **cursor) == [7, 8, 9]
    write("2", [10, 11])
    assert stream("c", after=6, **cursor) == [10, 11] and stream("c", after=6, **cursor) == []
    assert eventsource.read_cursor(f"{tmp_path}/cursor") >= 9
    write("3", [12])
    assert set(stream("new", **cursor)) >= {12} and not set(stream("new2", **cursor)) & set(range(10))


def test_feeds_by_format(spark, tmp_path):
    eventsource.register(spark)
    (tmp_path / "f").mkdir()
    for k in range(5):
        body = {"products": [{"handle": f"h{k}", "title": "T", "vendor": "V", "variants": [{"price": 12.5, "available": True}], "images": [{"src": "i"}, {}]}, {"title": "no handle"}, 3]}
        (tmp_path / "f" / f"{k}.json").write_text(json.dumps(body) if k else "<html>")
    rows = spark.read.format("quarry_feed").options(path=f"{tmp_path}/f", origin="https://x.example/", filesPerPartition=2).load()
    got = sorted((r.file, r.url, r.price, r.images, r.available) for r in rows.collect())
    assert got == [(f"{k}.json", f"https://x.example/products/h{k}", "12.5", ["i"], True) for k in range(1, 5)] and rows.rdd.getNumPartitions() == 3


def test_blocks_meet_once_in_a_grid(spark):
    left = spark.createDataFrame([(bytes([k]),) for k in range(23)], "q_ids binary")
    right = spark.createDataFrame([(bytes([k]),) for k in range(31)], "c_ids binary")
    a, b = index.gridded(left, right, "q_ids", "c_ids")
    met = b.join(a, (F.col("q_row") == F.col("c_row")) & (F.col("q_column") == F.col("c_column")))
    assert met.count() == met.select("q_ids", "c_ids").distinct().count() == 23 * 31
    side = a.select(F.max("q_column")).first()[0] + 1
    assert a.count() == 23 * side and b.count() == 31 * side
    assert met.groupBy("q_row", "q_column").count().agg(F.max("count")).first()[0] < 23 * 31 / 2
