"""Each query against its SQL, run by DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def same(df, want):
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    rows = lambda frame: sorted(map(str, frame[columns].astype(object).values.tolist()))
    assert rows(df.toPandas()) == rows(want.df())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name]))


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, sf):
    plan = QUERIES["filter_const"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_suppkey,7)" in plan and "l_quantity" not in plan
