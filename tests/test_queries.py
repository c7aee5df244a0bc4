"""Every query against its SQL in DuckDB on the smallest tables; the library without the optional folders."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 9))
    return str(v)[:19] if hasattr(v, "hour") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    got = sorted(tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect())
    out = con.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(frame.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in out.fetchall())


@pytest.mark.parametrize("name", sorted(k for k in set(QUERIES) - set(SQL) if not k.startswith("op") and k != "pipeline"))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_stands_without_optional_folders(tmp_path):
    root = Path(entry.__file__).parent
    for p in root.iterdir():
        if p.name not in {".git", "corpus_pipeline.py", "quarry", ".tmp"}:
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "quarry").mkdir()
    for p in (root / "quarry").iterdir():
        if p.name != "llm":
            (tmp_path / "quarry" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
