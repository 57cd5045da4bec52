"""Every registered query against its SQL on the smallest supplied data."""

import compare
import pytest

import __spark_entry__ as entry
from haloflux.plans import catalog, equivalents

QUERIES, SQL = catalog.all_queries(), equivalents.all_sql()
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


def test_queries_and_sql_name_the_same_results():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare.compare(spark, con, SF_DIR, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_unbounded_steps(spark, name):
    """No cross or nested-loop join, no sorted aggregate, no Python worker, and every sum combines before its shuffle."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for step in ("CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert step not in plan
    if "sum(" in plan:
        assert "partial_sum(" in plan


@pytest.mark.parametrize("name,scans", [("surface_budget", 2), ("surface_closure", 2), ("tendencies", 1), ("cv_volume_stats", 1), ("closure", 2), ("freq_compare", 8), ("interp_uv", 1), ("staggered_volumes", 1), ("time_slices", 4)])
def test_plan_reads_its_input_so_often(spark, name, scans):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= scans


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["cv_id", "ocean_time"] and df.count() > 0
