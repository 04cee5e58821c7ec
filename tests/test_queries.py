"""Every report query against its SQL in DuckDB, on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from vigil.plans import queries, stored  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, FOLDER)
    rows = [r.asDict() for r in got.collect()]
    if name not in queries.SQL:
        assert rows
        return
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    expected = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    key = lambda r: repr([plain(r[c]) for c in order])
    assert sorted(map(key, rows)) == sorted(map(key, expected))
