"""Planner, comparison and snapshot behaviour through the public API."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roughcut.operators import profile as prof
from roughcut.operators.samples import SampleStore
from roughcut.plans.aggregate import approx_aggregate, exact_aggregate
from roughcut.plans.compare import accuracy_sweep, compare_exact_approx, compare_strategies
from roughcut.session import shared_dir
from roughcut.sources.tables import generate_sales

AGGS = [("count", "*", "cnt"), ("sum", "amount", "total"), ("avg", "amount", "avg_amount")]


@pytest.fixture(scope="module")
def store(spark, sales):
    st = SampleStore(spark, shared_dir(spark, "test", "api-store"))
    st.build_tiers(sales, "sales", "event_id")
    st.build_stratified(sales, "sales", "region", "event_id", 0.1)
    return st


def test_stored_tier_and_strata_plans(sales, store):
    _, p = approx_aggregate(sales, AGGS, accuracy=0.90, table="sales", store=store, return_plan=True)
    assert (p.strategy, p.rate) == ("materialized_tier", 0.10)
    _, p = approx_aggregate(sales, AGGS, ["region"], table="sales", store=store, return_plan=True)
    assert p.strategy == "exact"  # two sampled rows of Antarctica cannot keep 95 %
    res, p = approx_aggregate(sales, AGGS[:1], ["region"], table="sales", store=store, return_plan=True)
    assert p.strategy == "materialized_stratified" and p.rate == 0.1
    rows = {r["region"]: r for r in res.collect()}
    assert set(rows) == {"US", "UK", "Antarctica"}
    assert {k: r["cnt"] for k, r in rows.items()} == {"US": 9000, "UK": 980, "Antarctica": 20}


def test_profile_row_skips_statistics_passes(sales):
    row = {"row_count": 10_000, "mean": 49.63, "stddev": 49.1, "group_gini_normalised": 0.1}
    _, p = approx_aggregate(sales, AGGS, ["region"], runtime_sampling=True, profile_row=row,
                            return_plan=True)
    assert p.strategy == "uniform"  # the given (low) skew wins over the data's


def test_sketch_plan_mixes_exact_and_sketched(sales):
    res, p = approx_aggregate(sales, [("count_distinct", "user_id", "users"), ("median", "amount", "med"),
                                      ("count", "*", "cnt")], accuracy=0.99, return_plan=True)
    r = res.first()
    assert p.strategy == "sketch" and p.hll_precision == 16
    assert r["cnt"] == 10_000 and r["cnt_error_pct"] == 0.0
    assert abs(r["users"] - 150) <= 3 and r["users_error_pct"] == pytest.approx(0.4063, abs=1e-4)
    assert abs(r["med"] - 34.59) / 34.59 < 0.02 and r["med_error_pct"] == 0.04


def test_exact_aggregate_with_quantiles(sales):
    r = exact_aggregate(sales, [("count", "*", "cnt"), ("median", "amount", "med"),
                                ("percentile", "amount", "p95", 0.95)]).first()
    assert (r["cnt"], r["med"], round(r["p95"], 4)) == (10_000, 34.59, 147.3535)
    g = {x["region"]: x["med"] for x in exact_aggregate(sales, [("median", "amount", "med")],
                                                         ["region"]).collect()}
    want = {x[0]: x[1] for x in sales.groupBy("region").agg(F.median("amount")).collect()}
    assert g.keys() == want.keys() and all(g[k] == pytest.approx(float(want[k])) for k in g)


def test_compare_and_sweep(sales, store):
    c = compare_exact_approx(sales, AGGS[:2], ["region"], runtime_sampling=True).collect()
    assert {r["strategy"] for r in c} == {"stratified"}
    assert all(r["accuracy_cnt"] == 1.0 for r in c)  # stratified COUNT is exact by construction
    s = compare_strategies(sales, AGGS[:2], ["region"], rate=0.1, key="event_id",
                           table="sales", store=store).collect()
    flags = {(r["strategy"], r["supported"]) for r in s}
    assert ("materialized_tier", True) in flags and ("sketch", False) in flags
    assert ("materialized_stratified", True) in flags
    w = accuracy_sweep(sales, AGGS, table="sales", store=store).collect()
    rates = [r["sample_rate"] for r in sorted(w, key=lambda r: r["accuracy_target"])]
    assert rates == sorted(rates) and rates[0] < 1.0 and rates[-1] == 1.0
    for r in w:
        assert max(r[f"{a[2]}_error_pct"] for a in AGGS) <= 100 * (1 - r["accuracy_target"]) + 1e-6


def test_profile_snapshot_ttl_and_invalidate(spark, sales):
    path = shared_dir(spark, "test", "snap")
    t0 = dt.datetime(2026, 1, 1)
    prof.save_profile(prof.profile_table(sales.drop("h")), path, t0)
    assert prof.load_profile(spark, path, now=t0 + dt.timedelta(minutes=19)) is not None
    assert prof.load_profile(spark, path, now=t0 + dt.timedelta(minutes=21)) is None
    prof.invalidate_profile(spark, path)
    assert prof.load_profile(spark, path, now=t0) is None


def test_generator_shape(spark):
    g = generate_sales(spark, 20_000, seed=1, num_partitions=4)
    assert g.columns == ["event_id", "user_id", "region", "amount", "date"]
    shares = {r["region"]: r["count"] / 20_000 for r in g.groupBy("region").count().collect()}
    assert 0.88 < shares["US"] < 0.92 and 0.08 < shares["UK"] < 0.12
    assert g.agg(F.max("amount")).first()[0] <= 1000


def test_planning_stats_from_stored_tier_not_table(spark, sales, store):
    """With stored tiers the planner reads the 20 % tier and the metadata,
    not the table: a table that fails when scanned proves it."""
    from roughcut.plans.aggregate import _planning_stats
    poisoned = sales.withColumn("amount", F.expr("raise_error('table scanned')"))
    n, m, sd, src = _planning_stats(poisoned, "amount", "sales", store, None, None)
    assert src == "stored sample" and n == 10_000 and 40 < m < 60


def test_planning_stats_from_profile(spark, sales):
    from roughcut.plans.aggregate import _planning_stats
    p = prof.profile_table(sales.drop("h"))
    n, m, sd, src = _planning_stats(sales, "amount", None, None, None, p)
    assert src == "profile" and n == 10_000 and round(m, 4) == 49.6307


def test_explicit_strategy_override(sales, store):
    res, p = approx_aggregate(sales, AGGS, ["region"], strategy="uniform", sample_rate=0.2,
                              return_plan=True)
    assert (p.strategy, p.rate) == ("uniform", 0.2)
    assert {r["strategy"] for r in res.collect()} == {"uniform"}
    _, p = approx_aggregate(sales, AGGS, strategy="materialized_tier", sample_rate=0.01,
                            table="sales", store=store, return_plan=True)
    assert (p.strategy, p.rate) == ("materialized_tier", 0.01)
    with pytest.raises(ValueError):
        approx_aggregate(sales, AGGS, strategy="reservoir")


def test_runtime_sampling_with_xxhash(spark):
    """Without a stored hash the planner can hash keys with xxhash64; the
    plan then has no md5 and the estimates stay sensible."""
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    res = approx_aggregate(li, [("count", "*", "cnt"), ("sum", "l_quantity", "q")], ["l_returnflag"],
                           key=key, runtime_sampling=True, accuracy=0.95)
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan and "md5" not in plan
    exact = {r[0]: r[1] for r in li.groupBy("l_returnflag").count().collect()}
    for r in res.collect():
        assert abs(r["cnt"] - exact[r["l_returnflag"]]) / exact[r["l_returnflag"]] < 0.1


def test_planner_takes_skew_from_stored_profile(spark, sales):
    """A profile built with skew columns answers the planner's skew question:
    with it, grouping a poisoned table plans without scanning it."""
    path = shared_dir(spark, "test", "skew-profile")
    p = prof.cached_profile(sales.drop("h"), path, skew_columns=["region"])
    assert round(p.filter("column_name = 'region'").first()["group_gini_normalised"], 3) == 0.898
    poisoned = sales.withColumn("amount", F.expr("raise_error('table scanned')"))
    _, plan = approx_aggregate(poisoned, AGGS, ["region"], runtime_sampling=True, profile=p,
                               return_plan=True)
    assert plan.strategy == "stratified" and plan.rate == 0.05


def test_stratified_errors_are_per_estimate(sales, store):
    """Under the sound default, an unfiltered stratified COUNT is exact
    (error 0) and SUM/AVG report their own interval margins; the parity
    option reports the reference's per-stratum figure for all three."""
    for kw in (dict(strategy="stratified"), dict(strategy="materialized_stratified", table="sales", store=store)):
        rows = approx_aggregate(sales, AGGS, ["region"], **kw).collect()
        for r in rows:
            assert r["cnt_error_pct"] == 0.0
            if r["region"] != "Antarctica":
                assert 0 < r["total_error_pct"] < 30 and 0 < r["avg_amount_error_pct"] < 30
    par = approx_aggregate(sales, AGGS, ["region"], strategy="stratified",
                           bound_method="proportion").collect()
    assert all(r["cnt_error_pct"] == r["total_error_pct"] == r["avg_amount_error_pct"] for r in par)
