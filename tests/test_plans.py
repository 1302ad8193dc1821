"""Physical-plan checks: no cartesian products, no row-at-a-time Python UDFs, pruning and pushdown reach parquet."""

import pytest

from escalade.plans.catalog import all_queries
from tests.conftest import SF01

# queries that train models, write files or run a stream while they are built
EAGER = ("M1", "M2", "M3", "M4", "M5", "R5", "S3_", "S4_", "S9_", "ST1_assemble_chunks_stream",
         "ST2_window_cost_by_model_stream", "ST3")
QUERIES = all_queries()
LAZY = sorted(n for n in QUERIES if not n.startswith(EAGER))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_or_row_udf(spark, name):
    plan = _plan(QUERIES[name].build(spark, SF01))
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan  # only Arrow-batched Python is allowed


def test_scan_prunes_columns(spark):
    plan = _plan(QUERIES["A1_routing_metrics"].build(spark, SF01))
    scans = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line]
    text = " ".join(scans)
    assert "user_id" not in text and "event_id" not in text


def test_filters_reach_parquet(spark):
    plan = _plan(QUERIES["R8_cascade"].build(spark, SF01))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)" in plan


def test_similarity_router_has_no_pair_rows(spark):
    plan = _plan(QUERIES["R4_sw_win_rate"].build(spark, SF01))
    assert "FlatMapCoGroupsInPandas" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
