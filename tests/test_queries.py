"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from noticeflow.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert got
        return
    out = duck.sql(ORACLE[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
