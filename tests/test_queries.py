"""Every query runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ORACLE = entry.oracle_sql()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLE:
        return
    got = duck.execute(ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(norm(r[i]) for i in at) for r in got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["tbl", "fld", "row_key", "kind", "period"]


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "quernstone"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "quernstone.llm" not in f.read_text(), f
