"""What keeps queries from growing faster than their tables: who reads rows, what is made once, what one task holds."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import udfs
from quarry.functions import url as U
from quarry.operators import index, ranking
from quarry.sources import feeds

QUERIES = entry.queries()


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_members_makes_each_url_once(spark):
    body = '<a href="/items/1?utm_source=a"><a href="/items/1"><a href="/x"><a href="https://far.example/items/2">'
    found = feeds.members(spark.createDataFrame([("https://x.example/l", body)], "u string, b string"), "b", "u", ["/items/"], ["x.example"])
    assert [tuple(r) for r in found.collect()] == [("https://x.example/l", "https://x.example/items/1")]
    assert plan_of(found).count(U.PARTS) <= 5  # four parts of a URL and the host of the canonical one
    every = feeds.members(spark.createDataFrame([("https://x.example/l", body), ("https://x.example/n", None)], "u string, b string"), "b", "u", [], [])
    assert every.count() == 3


def test_listed_members_deals_parts_before_pages(spark, sf_dir):
    assert "RepartitionByExpression [p_partkey" in plan_of(QUERIES["listed_members"](spark, sf_dir))


def test_reach_strategies_deals_parts_before_urls(spark, sf_dir):
    assert "RepartitionByExpression [p_partkey" in plan_of(QUERIES["reach_strategies"](spark, sf_dir))


def test_ranks_and_places_without_a_task_for_a_tab(spark, monkeypatch):
    """Tabs in order, also a null one; a family with half of a tab; stretches of seven ranks. No window goes over a tab's rows."""
    monkeypatch.setattr(ranking, "STRETCH", 7)
    n = F.col("id")
    rows = spark.range(200).select("id", F.when(n % 10 > 0, F.when(n % 3 > 0, "a").otherwise("b")).alias("tab"), F.when(n % 2 > 0, n % 17).alias("family"), (n * 7 % 5).alias("k"))
    ranked = ranking.rank_tab(rows, "tab", [F.col("k")], "id")
    placed = ranking.diversify(ranked, "tab", "family")
    got = {r.id: (r["rank"], r.place) for r in placed.collect()}
    want = {}
    data = rows.collect()
    for tab in ("a", "b", None):
        own = sorted((r for r in data if r.tab == tab), key=lambda r: (-r.k, r.id))
        seen, firsts, repeats = set(), [], []
        for r in own:
            (repeats if r.family in seen else firsts).append(r.id)
            seen.add(r.family)
        place = {x: p for p, x in enumerate(firsts + repeats, 1)}
        want |= {r.id: (k, place[r.id]) for k, r in enumerate(own, 1)}
    assert got == want and [t for c, t in placed.dtypes if c in ("rank", "place")] == ["int", "int"]
    for frame in (ranked, placed):
        numbered = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*?) (?:ASC|DESC)", plan_of(frame))
        assert numbered and all("_range" in x or "_stretch" in x for x in numbered)


def test_phrases_are_searched_for_only_where_their_stems_are(monkeypatch):
    """A text with one stem is searched for that stem's phrases alone; every phrase spells a stem and is in one pattern."""
    assert all(udfs._stems(p) for p in udfs.REPLICA)
    assert sum(p.pattern.count("|".join(x for x in udfs.REPLICA if udfs._stems(x) == k)) for k, p in udfs._BY_STEMS.items()) == len(udfs._BY_STEMS)
    searched = []

    class Noted:
        def __init__(self, stems):
            self.stems = stems

        def search(self, text):
            searched.append(self.stems)

    monkeypatch.setattr(udfs, "_BY_STEMS", {k: Noted(k) for k in udfs._BY_STEMS})
    assert not udfs._phrase("a bootleg") and searched and all("bootleg" in s for s in searched)


def test_ascii_folds_as_all_texts_do():
    every = "".join(map(chr, range(128)))
    assert udfs.fold(every) == udfs.fold(every + "é")[:-1]


def test_a_task_gives_out_its_best_vectors_once_however_few_files_hold_them(spark, monkeypatch):
    """Every block of eight holds better ones than the block before: no more than five of a query leave a task, and one file's blocks go to all tasks."""
    frame = spark.createDataFrame([(k, [1.0, 10.0 - k / 200]) for k in range(2000)], "k long, v array<double>").coalesce(1)
    asked, blocks, found = spark.createDataFrame([(-1, [1.0, 0.0]), (-2, [2.0, 0.0])], "k long, v array<double>"), index.cosine_blocks, []

    def noted(*a, **k):
        found.append(blocks(*a, **k | {"rows": 8}))
        return found[-1]

    monkeypatch.setattr(index, "cosine_blocks", noted)
    hits = index.vector_search(asked, frame, "k", "v", limit=5)
    assert {(r.query_id, r.listing_key) for r in hits.collect()} == {(q, k) for q in (-1, -2) for k in range(1995, 2000)}
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert found[0].rdd.getNumPartitions() == tasks and found[0].count() <= tasks * 2 * 5
    assert found[0].select(F.spark_partition_id().alias("p")).distinct().count() > tasks / 2


def test_tops_keep_the_first_of_equal_ones():
    rng = np.random.default_rng(3)
    for limit, least in ((5, 0.0), (1, -2.0), (400, 0.0)):
        every, cos = rng.permutation(300), np.round(rng.normal(0, 0.3, (7, 300)), 1)
        cos[:, rng.permutation(300)[:60]] = 0.9
        cos[2, ::3] = np.nan
        cos[4] = -1.0
        tops = index.Tops(np.arange(7) * 20, limit, least)
        for at in range(0, 300, 23):
            tops.add(every[at : at + 23], cos[:, at : at + 23])
        got = [tuple(r.values()) for r in tops.batch().to_pylist()]
        want = [(q * 20, int(c), -s) for q in range(7) for s, c in sorted((-s, c) for s, c in zip(cos[q].tolist(), every.tolist(), strict=True) if s >= least)[:limit]]
        assert got == want
