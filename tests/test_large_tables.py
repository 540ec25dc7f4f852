"""What comes up only in tables larger than the test data: queries over a few such keys against DuckDB."""

import duckdb
import pytest

from readroute.queries import ORACLES, QUERIES


@pytest.fixture
def same(spark, tmp_path):
    """Runs a query and its SQL over the given tables, and compares the rows."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
            con.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet'")
        want = con.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        rows = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*names).collect()]
        assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)

    return check


def test_destinations_of_reads_that_begin_with_twelve_of_one_base(same):
    same("destinations", orders="SELECT unnest([5, 954206, 4075912, 4722518]) AS o_orderkey")


def test_search_of_tags_that_were_alike(same):
    parts = "SELECT unnest([2609, 60416, 89312]) AS p_partkey"
    same("search_tag_table", part=parts, lineitem=f"SELECT p_partkey AS l_partkey, o AS l_orderkey, 1 AS l_linenumber FROM ({parts}), range(100) v(o)")
