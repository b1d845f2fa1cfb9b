"""Queries read whole tables: on small tables with ids and orders of any size, against their SQL."""

import duckdb
import pytest

from tests.test_queries import same
from tidemark.queries import ORACLE_SQL, QUERIES

PATHS = [(20, 21, 22, 23), (23, 24, 20), (25, 26, 25), (27, 27), (28, 29, 30), (28, 30), (7, 0, 7), (0, 1)]
HOPS = {(a, b) for path in PATHS for a, b in zip(path, path[1:], strict=False)}
OVER_HOPS = [n for n, sql in ORACLE_SQL.items() if "hop AS" in sql]


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    lines = [(100 + 1000 * k, n, s) for k, path in enumerate(PATHS) for n, s in enumerate(path, 1)]
    tables = {
        "lineitem": f"SELECT * FROM (VALUES {', '.join(map(str, lines))}) t(l_orderkey, l_linenumber, l_suppkey)",
        "supplier": "SELECT CAST(k AS INTEGER) AS s_suppkey, CAST(k % 3 AS INTEGER) AS s_nationkey FROM range(3, 33) t(k)",
        "nation": "SELECT CAST(k AS INTEGER) AS n_nationkey FROM range(3) t(k)",
    }
    con = duckdb.connect()
    for name, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", [*OVER_HOPS, "coverage_gaps", "coverage_overlap"])
def test_against_sql(spark, far, name):
    folder, con = far
    same(QUERIES[name](spark, folder), con.sql(ORACLE_SQL[name]))


def test_closure_of_all_orders(spark, far):
    want = set(HOPS)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    assert {tuple(r) for r in QUERIES["hop_closure"](spark, far[0]).collect()} == want
    assert {r["x"] for r in QUERIES["filter_repeat"](spark, far[0]).collect()} == {27}


def test_gaps_of_all_suppliers(spark, far):
    gaps = {tuple(r) for r in QUERIES["coverage_gaps"](spark, far[0]).collect()}
    assert gaps == {(f"nation {n}", f"supplier {k}") for n in range(3) for k in range(3, 33) if n != k % 3}
