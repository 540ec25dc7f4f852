"""Registered routing queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from readroute.queries import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer part orders lineitem events conversations documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    rows = [tuple(r) for r in df.select(*names).collect()]
    expected = [tuple(x if not (isinstance(x, float) and math.isnan(x)) else None for x in r) for r in want.fetchall()]
    assert sorted(rows, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
