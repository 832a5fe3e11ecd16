"""Every registered query against its DuckDB twin (sf0.001 for speed;
``tests/oracle_check.py`` runs the same at sf0.01, the driver's scale)."""

import pytest

import __spark_entry__ as entry
from roughcut.suite import QUERIES
from tests.conftest import SF001
from tests.oracle_check import compare, duck

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin", "SortAggregate",
             "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [n for n in BAD_NODES if n in plan]
    assert not bad, f"{name} plans {bad}"
    status, msg, _ = compare(spark, con, name, entry.queries()[name],
                             entry.oracle_sql().get(name), SF001, df=df)
    assert status == "ok", msg


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert {r["region"] for r in rows} == {"US", "UK", "Antarctica"}
