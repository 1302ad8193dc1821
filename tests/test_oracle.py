"""Differential tests: every registered query with an oracle equals DuckDB on the same tables (sf0.01)."""

import pytest

from escalade.plans.catalog import all_queries
from escalade.plans.oracle_check import compare, duckdb_connection
from tests.conftest import SF01

QUERIES = all_queries()
WITH_ORACLE = sorted(n for n, q in QUERIES.items() if q.oracle)
ROWS_ONLY = sorted(n for n, q in QUERIES.items() if not q.oracle)


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF01)


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_query_matches_oracle(spark, con, name):
    q = QUERIES[name]
    r = compare(spark, name, q.build, q.oracle, SF01, con)
    assert r.ok, r.detail


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name].build(spark, SF01).count() > 0


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["total_requests"] == 1000
    assert set(e.oracle_sql()) <= set(e.queries())
