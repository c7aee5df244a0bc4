"""Matching, planning and campaign operators on small frames."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import images as I
from quarry.operators import campaign, matching, planning


def test_view_pairs_keep_to_their_budget(spark):
    refs = spark.createDataFrame([(s, f"{s}{i}", v) for s in (1, 2) for i, v in enumerate(["lateral", "front", "sole", "label"])], "search_id int, reference_id string, ref_view string")
    cand = spark.createDataFrame([(1, "c", f"i{i}", v) for i, v in enumerate(["front", "lateral", "top", "sole"])], "search_id int, candidate_id string, image_id string, view string")
    rows = matching.view_pairs(refs, cand).orderBy("pair").collect()
    assert len(rows) == 9 and [(r.ref_view, r.view) for r in rows[:3]] == [("lateral", "lateral"), ("front", "front"), ("sole", "sole")]


def test_worst_pair_decides(spark):
    rows = spark.createDataFrame([("c", 0.02, True), ("c", 0.2, True), ("d", 0.02, True), ("e", 0.2, False)], "candidate_id string, colour_distance double, exact boolean")
    got = {r.candidate_id: (round(r.colour, 3), r.contradiction) for r in matching.colour_across(rows, F.col("exact")).collect()}
    assert got == {"c": (0.25, "hard"), "d": (0.936, None), "e": (0.36, "soft")}
    rows = spark.createDataFrame([("c", "r", "i", 0.9, 0.95), ("c", "r", "j", 0.4, 0.5)], "candidate_id string, reference_id string, image_id string, geometry double, mirrored double")
    assert tuple(matching.construction_across(rows).first()) == ("c", 0.5, "r", "j")


def test_references_unify(spark):
    rows = [(1, "a", "0" * 16, [1.0, 0.0]), (1, "b", "0" * 13 + "f" * 3, [0.9, 0.1]), (1, "c", "0" * 16, [0.0, 1.0]), (1, "d", "f" * 16, [1.0, 0.0]), (1, "e", "0" * 16, [1.0, 0.0]), (2, "x", "0" * 16, [1.0, 0.0])]
    out = {r.image_id: (r.cluster, r["size"], r.place) for r in matching.unify_references(spark.createDataFrame(rows, "search_id int, image_id string, hash string, histogram array<double>")).collect()}
    assert out == {"a": ("a", 3, 1), "b": ("a", 3, 1), "e": ("a", 3, 1), "c": ("c", 1, 2), "d": ("d", 1, 3), "x": ("x", 1, 1)}


def test_parts_and_galleries(spark):
    spec = spark.createDataFrame([("shoe", "sole", True), ("shoe", "lace", False)], "category string, part string, critical boolean")
    parts = spark.createDataFrame([("c", "shoe", "lace", True, 0.2), ("d", "shoe", "sole", False, 0.5)], "candidate_id string, category string, part string, strong boolean, confidence double")
    assert {r.candidate_id: (r.parts_mean, r.critical_missing) for r in matching.compare_parts(spec, parts).collect()} == {"c": (0.95, 1), "d": (0.5, 0)}
    shade = lambda k, view, x, e: (k, view, e, 2, None, [x, x, x], 0.5)
    g = spark.createDataFrame([shade("c", "lateral", 0.0, 6), shade("c", "front", 255.0, 3), shade("d", "front", 1.0, 0), shade("e", "top", 9.0, 0), shade("e", "top", 9.0, 0)], "candidate_id string, view string, eyelet_count int, panel_count int, label_hash string, rgb array<double>, smoothness double")
    got = {r.candidate_id: (round(r.colour_spread, 2), round(r.score, 2), r.contradictions) for r in matching.gallery_consistency(g).collect()}
    assert got == {"c": (1.0, 0.2, ["gallery-eyelet-incompatible"]), "d": (0.0, 0.55, []), "e": (0.0, 1.0, [])}


def test_cheap_signals(spark):
    rows = spark.sql("SELECT array('red','boot') query_terms, array('red','boot','guidi') listing_terms, array('red') ocr_terms, '00ff' ref_hash, '00ff' phash, array(1D,0D) ref_histogram, array(1D,0D) histogram, 'm' ref_mask, 'm' mask, 'shoe' category, CAST(NULL AS STRING) listed_category, 'Guidi' brand, CAST(NULL AS DOUBLE) embedding")
    recall = matching.cheap_signals(rows).first().recall
    assert recall == pytest.approx(0.32 * (0.55 * 2 / 3 + 0.45) + 0.12 * (0.55 / 2 + 0.45) + 0.22 + 0.14 + 0.08 + 0.07 * 0.4 + 0.05, abs=1e-6)


@pytest.mark.parametrize(("text", "want"), [
    ("Guidi 788 black leather boots size 42 2019", {"year": 2019, "colours": ["black"], "materials": ["leather"], "category": "footwear", "brand": "guidi", "model": "788"}),
    ("dior ss 04 us 9 runner", {"year": 2004, "brand": "dior", "model": "ss runner"}), ("chanel 98 bag", {"year": 1998, "category": "bag", "brand": "chanel"}), (None, {"brand": None}),
])
def test_requests(text, want):
    got = planning.read_request(text)
    assert {k: got[k] for k in want} == want


def test_plans(spark):
    h = spark.createDataFrame([("s", 1, 0.6, "guidi", "788", 2019, "boot", "black", "leather", None, None)], "search_id string, id int, posterior double, brand string, model string, year int, category string, colour string, material string, code string, season string")
    d = planning.drafts(h)
    assert {r.text for r in d.where("round = 0").collect()} == {"guidi 788", "guidi 788 2019"} and d.where("family = 'code'").count() == 0
    prior = spark.createDataFrame([("s", "guidi 788")], "search_id string, text string")
    gain = {r.text: (r.overlap, r.gain) for r in planning.with_gain(d, prior, F.lit(4)).collect()}
    assert gain["guidi 788"] == (1.0, 0.0) and gain["black leather boot"][0] == 0.0
    left = planning.drop_demoted(d, spark.createDataFrame([("s", "Replica")], "search_id string, term string"))
    assert left.count() == d.count() - 1
    seeds = planning.seed_portfolio(spark.createDataFrame([("s", "guidi 788 boots 2019")], "search_id string, text string")).collect()
    assert len(seeds) == 4 and abs(sum(r.posterior for r in seeds) - 1) < 1e-3


def test_robots_and_admission(spark):
    rules = planning.robots_rules("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /a # x\nAllow: /a/b\nDisallow:\n")
    assert not planning.robots_allow(rules, "/a/c") and planning.robots_allow(rules, "/a/b/c") and planning.robots_allow(rules, "/z")
    rows = [(1, "https://x.example/p/1", True, False, ["/p"], ""), (2, "https://x.example/p/1", True, False, ["/p"], None), (3, "https://x.example/q", True, False, ["/p"], ""), (4, "http://127.0.0.1/p", True, False, ["/p"], ""), (5, "https://x.example/p", False, True, ["/p"], "")]
    out = planning.admission(spark.createDataFrame(rows, "i int, url string, enabled boolean, blocked boolean, prefixes array<string>, robots string"))
    assert [r.outcome for r in out.orderBy("i").collect()] == ["ADMITTED", *["BLOCKED_BY_POLICY"] * 3, "DISABLED"]


def test_beliefs(spark):
    b = spark.createDataFrame([("k", "old", 0.4, [])], "key string, value string, confidence double, history array<struct<value string, confidence double>>")
    n = spark.createDataFrame([("k", "new", 0.7), ("k", "weak", 0.1)], "key string, value string, confidence double")
    r = planning.update_belief(b, n).first()
    assert (r.value, r.confidence, [tuple(h) for h in r.history]) == ("new", 0.7, [("old", 0.4)])
    assert planning.update_belief(planning.update_belief(b, n), n.where("confidence < 0.5")).first().value == "new"


def test_campaign(spark):
    raw = spark.createDataFrame([("s", "https://x.example/products/a?ref=1", "<b>Boot</b>", None, "1.299,50 €", None, "US 9", "売却済")], "source_id string, url string, title string, description string, price string, currency string, size string, availability string")
    r = campaign.normalise(raw).first()
    assert (r.canonical_url, r.listing_id, r.title, float(r.price), r.currency, r["size"].converted, r.availability, r.cluster_key) == ("https://x.example/products/a", "a", "Boot", 1299.5, "EUR", "EU 42", "SOLD", "s:a")
    assert r.field_records["price"].original == "1.299,50 €" and r.field_records["price"].fact_class == "REPORTED_BY_SELLER"
    iv = "struct<mean double, lower_bound double, upper_bound double>"
    kind = f"candidate_id string, listing_key string, item_match {iv}, authenticity {iv}, calibrated boolean, completeness double, live boolean, verified boolean, hard_item int, hard_auth int, scam boolean, stolen boolean, screened boolean, malicious boolean, replica boolean, link boolean"
    good = ("a", "a", (0.95, 0.92, 1.0), (0.9, 0.85, 1.0), True, 0.8, True, True, 0, 0, False, False, True, False, False, True)
    swap = lambda i, k, v: (k, *good[1:i], v, *good[i + 1 :])
    rows = [good, swap(8, "b", 1), swap(12, "c", False), swap(14, "d", True), swap(15, "e", False), swap(6, "f", False)]
    judged = campaign.judge(spark.createDataFrame(rows, kind))
    assert {x.candidate_id: x.bucket for x in judged.collect()} == {"a": "REAL", "b": "HIDDEN", "c": "POSSIBLY_REAL", "d": "REPLICA", "e": "HIDDEN", "f": "HIDDEN"}
    assert {x.bucket for x in campaign.judge(spark.createDataFrame([swap(6, "f", False)], kind), "provisional-1").collect()} == {"POSSIBLY_REAL"}
    assert len(campaign.questions(judged).first().answers) == 10
    stored = spark.createDataFrame([good], kind).drop("candidate_id")
    assert campaign.replay(spark.createDataFrame([("a", "a")], "candidate_id string, listing_key string"), stored).first().bucket == "POSSIBLY_REAL"
    checks = spark.createDataFrame([("a", "price", "support"), ("a", "size", "missing")], "candidate_id string, field string, verdict string")
    v = {x.candidate_id: (x.verified_fields, x.unseen_fields) for x in campaign.with_verification(judged, checks).collect()}
    assert v["a"] == (["price"], ["size"]) and v["b"] == ([], [])


def test_consult_and_status(spark):
    now = dt.datetime(2024, 1, 2)
    listings = spark.createDataFrame([("k", "u1", "LIVE", dt.datetime(2024, 1, 1)), ("m", "u2", "LIVE", dt.datetime(2024, 1, 1, 23))], "listing_key string, canonical_url string, availability string, last_checked_at timestamp")
    hits = spark.createDataFrame([("k",), ("m",)], "listing_key string")
    known = spark.createDataFrame([], "canonical_url string")
    assert {r.listing_key: r.availability for r in campaign.consult(hits, listings, known, F.lit(now)).collect()} == {"k": "UNKNOWN", "m": "LIVE"}
    outs = lambda *x: F.array(*(F.lit(o) for o in x))
    s = lambda said, pages, n, queries, enough, outcomes: spark.range(1).select(campaign.terminal_status(*(F.lit(v) for v in (said, pages, n, queries, enough)), outcomes)).first()[0]
    cases = [("COMPLETE", 5, 2, 3, False, outs("SEARCHED_NO_MATCH")), ("CANCELLED", 0, 0, 0, False, outs()), ("COMPLETE", 5, 2, 0, False, outs()), ("COMPLETE", 0, 0, 3, False, outs()), ("COMPLETE", 5, 0, 3, False, outs("PARSER_FAILED")), ("COMPLETE", 0, 0, 0, True, outs("PARSER_FAILED"))]
    assert [s(*c) for c in cases] == ["COMPLETE", "CANCELLED", "BLOCKED", "BLOCKED", "PARTIAL", "COMPLETE"]


def test_image_kernels(spark):
    image = np.full((16, 16, 3), 255.0)
    image[4:12, 6:10] = 0
    s = I.statistics(image)
    assert s["box"] == [0.375, 0.25, 0.625, 0.75] and s["subject_area"] == 32 / 256 and len(I.average_hash(image)) == 16
    h = I.colour_histogram(image)
    assert len(h) == 24 and h[0] == 32 / 256 and h[7] == 224 / 256
    flat = I.statistics(np.full((3, 3, 1), 9.0))
    assert flat["box"] is None and flat["edge_mean"] == 0.0
    row = spark.createDataFrame([(bytearray(image.astype(np.uint8).tobytes()), 16, 16)], "d binary, w int, h int").select(I.hash_of("d", "w", "h").alias("a"), I.histogram_of("d", "w", "h").alias("b"), I.statistics_of("d", "w", "h").alias("c")).first()
    assert row.a == I.average_hash(image) and row.b == h and row.c.box == s["box"]


def test_view_pairs_do_not_shuffle_candidates_by_search(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["view_pairs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
