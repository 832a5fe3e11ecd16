"""End to end, the way the original service is used: generate a skewed
table, profile it, build the stored samples, then answer the corpus at
every accuracy target and compare with the exact answers (generator
fixture; the registered queries read the given tables instead)."""

import pytest
from pyspark.sql import functions as F

from roughcut.functions.hashing import with_row_hash
from roughcut.operators import profile as prof
from roughcut.operators.samples import SampleStore
from roughcut.plans.aggregate import approx_aggregate, exact_aggregate
from roughcut.plans.compare import ACCURACY_LEVELS
from roughcut.session import shared_dir
from roughcut.sources.tables import generate_sales

N = 200_000


@pytest.fixture(scope="module")
def world(spark):
    path = shared_dir(spark, "test", "workflow")
    with_row_hash(generate_sales(spark, N, seed=3, num_partitions=8), "event_id") \
        .write.mode("overwrite").parquet(f"{path}/sales")
    sales = spark.read.parquet(f"{path}/sales")
    profile = prof.cached_profile(sales.drop("h"), f"{path}/profile", skew_columns=["region"])
    store = SampleStore(spark, f"{path}/samples")
    store.build_tiers(sales, "sales", "event_id")
    store.build_stratified(sales, "sales", "region", "event_id", 0.1)
    return sales, profile, store


@pytest.mark.parametrize("accuracy", ACCURACY_LEVELS)
def test_ungrouped_corpus_within_stated_error(world, accuracy):
    sales, profile, store = world
    aggs = [("count", "*", "cnt"), ("sum", "amount", "total"), ("avg", "amount", "avg_amount")]
    res, plan = approx_aggregate(sales, aggs, accuracy=accuracy, table="sales", store=store,
                                 profile=profile, return_plan=True)
    assert plan.strategy == ("exact" if accuracy == 0.99 else "materialized_tier")  # 20 % cannot keep 99 %
    r, ex = res.first(), exact_aggregate(sales, aggs).first()
    assert r["cnt"] == N  # realised-rate scaling of a stored tier
    for a in ("total", "avg_amount"):
        rel = abs(r[a] - ex[a]) / abs(ex[a]) * 100
        assert rel <= 2 * r[f"{a}_error_pct"], (a, rel, r[f"{a}_error_pct"])
        assert r[f"{a}_error_pct"] <= 100 * (1 - accuracy) + 1e-6


def test_grouped_corpus_uses_stored_strata(world):
    sales, profile, store = world
    aggs = [("count", "*", "cnt"), ("sum", "amount", "total")]
    res, plan = approx_aggregate(sales, aggs, ["region"], accuracy=0.5, table="sales",
                                 store=store, profile=profile, return_plan=True)
    assert plan.strategy == "materialized_stratified"
    got = {r["region"]: r for r in res.collect()}
    ex = {r["region"]: r for r in exact_aggregate(sales, aggs, ["region"]).collect()}
    assert got.keys() == ex.keys() == {"US", "UK", "Antarctica"}
    for k in ("US", "UK"):
        assert got[k]["cnt"] == ex[k]["cnt"]
        assert abs(got[k]["total"] - ex[k]["total"]) / ex[k]["total"] < 0.05


def test_skewed_group_without_stored_strata_goes_stratified(world):
    sales, profile, _ = world
    _, plan = approx_aggregate(sales, [("count", "*", "cnt")], ["region"], accuracy=0.95,
                               profile=profile, runtime_sampling=True, return_plan=True)
    assert plan.strategy == "stratified"


def test_distinct_and_quantile_through_sketches(world):
    sales, profile, store = world
    res, plan = approx_aggregate(sales, [("count_distinct", "user_id", "users"),
                                         ("median", "amount", "med")], accuracy=0.99,
                                 profile=profile, return_plan=True)
    r = res.first()
    ex = sales.agg(F.count_distinct("user_id"), F.median("amount")).first()
    assert plan.strategy == "sketch"
    assert abs(r["users"] - ex[0]) / ex[0] < 3 * r["users_error_pct"] / 100
    below = sales.filter(F.col("amount").cast("double") <= r["med"]).count() / N
    assert abs(below - 0.5) < 0.01
