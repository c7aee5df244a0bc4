"""Conversation repair against all edit sequences, and against the SQL, with long, empty, null and repeated conversations."""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import duckdb
import pytest

from quarry.llm import conversations as C
from quarry.llm.queries import ORACLE_SQL, QUERIES

WANTED = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, n string, later int, path string"


def cheapest(rows):
    """All edit sequences, of (initial, mark, copies) rows with at most two inserts in each gap."""

    @lru_cache(None)
    def ways(initial, mark):
        if mark == C.GONE:
            return (("D", "", 4),)
        extra = 3 if mark == C.TRUNCATED else 0
        return (("D", "", 4), ("K", initial, extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra))

    flat = [(i, m if k == 0 else C.GONE) for i, m, n in rows for k in range(n + 1)]
    inserts = [("", "", 0), *(("I", x, 3) for x in "ua"), *(("II", x + y, 6) for x in "ua" for y in "ua")]
    paths = {("", ""): 0}
    for at in range(len(flat) + 1):
        grown = {}
        for (audit, roles), cost in paths.items():
            for letters, more, c in inserts:
                for letter, role, d in ways(*flat[at]) if at < len(flat) else (("", "", 0),):
                    new = audit + letters + letter, roles + more + role
                    if re.fullmatch(r"s?(ua)*u?", new[1]):
                        grown[new] = min(grown.get(new, 10**9), cost + c + d)
        paths = grown
    return min((c, audit) for (audit, roles), c in paths.items() if WANTED.fullmatch(roles))


def test_plans_against_all_edit_sequences():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice("suaut "), rng.choice(["k", "k", "t", "d"]), rng.choice([0, 0, 0, 1])) for _ in range(rng.randint(0, 4))]
        whole = C.plans(C.START, rows)
        assert C.ended(whole)[:2] == cheapest(tuple(rows)), rows


def test_chained_plans_equal_one_plan():
    rng = random.Random(6)
    for _ in range(100):
        rows = [(rng.choice("sua "), rng.choice("kktd"), 0) for _ in range(rng.randint(2, 30))]
        cut = rng.randint(1, len(rows) - 1)
        two = C.chained({e: C.plans(e, rows[:cut]) for e in range(4)}, {e: C.plans(e, rows[cut:]) for e in range(4)})
        for entry in range(4):
            assert {s: w[:2] for s, w in two[entry].items()} == {s: w[:2] for s, w in C.plans(entry, rows).items()}


def fixture_rows():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "And then", "", " \t", "Long?\n", "x" * 30_000 + ".", "é ü.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    rows = [(c, t, rng.choice(roles), rng.choice(texts), "clash", 1, "clash") for c in range(60) for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    rows += [(1000, t, rng.choice(roles[:4]), rng.choice(texts[:5]) or None, "a", 2, "b") for t in range(900)]
    rows += [(None, 1, "user", "Null.", "", 0, ""), (None, 2, "assistant", "Null.", "", 0, ""), (77, None, "user", "No turn.", "", 0, ""), (77, None, "user", "No turn.", "", 0, ""), (77, 3, "assistant", "Turn.", "", 0, "")]
    rows += [(88, None, "user", "only nulls", "", 0, "")] + [(99, 5, "user", "Same.", "", 0, "")] * 40
    return rows


@pytest.fixture(scope="module")
def convs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("convs")
    spark.createDataFrame(fixture_rows(), SCHEMA).repartition(4).write.parquet(f"{d}/conversations.parquet")
    return str(d)


def answer(where):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{where}/conversations.parquet/*.parquet'")
    out = con.execute(ORACLE_SQL["op11_conversation_repair"])
    names = [d[0] for d in out.description]
    return {r[names.index("conv_id")]: dict(zip(names, r, strict=True)) for r in out.fetchall()}


def test_query_equals_sql_on_awkward_rows(spark, convs):
    got = {r.conv_id: r.asDict() for r in QUERIES["op11_conversation_repair"](spark, convs).collect()}
    assert got == answer(convs) and set(got) == {r[0] for r in fixture_rows()}


@pytest.mark.parametrize("size", [1, 3, 50])
def test_chunks_do_not_matter(spark, convs, size):
    rows = C.damaged(spark.read.parquet(f"{convs}/conversations.parquet"))
    done, want = C.repair(rows, chunk_rows=size, chunk_chars=10_000), answer(convs)
    for r in done.summary.collect():
        assert (r.audit, r.cost, r.gaps, r.illegal, r.blank, r.duplicate, r.truncated) == tuple(want[r.conv_id][k] for k in ("audit", "cost", "gaps", "illegal", "blank", "duplicate", "truncated"))
    lines = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.part, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, x in lines.items():
        assert hashlib.sha256("\n".join(x).encode()).hexdigest() == want[conv]["repaired_sha256"]
    assert {r.conv_id: r.sha256 for r in C.digests(done.turns).collect()} == {c: want[c]["repaired_sha256"] for c in lines}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    done = C.repair(C.damaged(none))
    assert done.summary.count() == 0 and done.turns.count() == 0 and C.digests(done.turns).count() == 0
