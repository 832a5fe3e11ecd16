"""Filtered SUMs per stratum state what they do not know, and no planned answer lacks a group."""

import pytest
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.frames import join_on_groups
from roughcut.operators import sampling, stratified
from roughcut.operators.blocks import block_aggregate, block_sample
from roughcut.operators.samples import SampleStore
from roughcut.plans.aggregate import approx_aggregate, exact_aggregate
from roughcut.plans.compare import compare_strategies
from roughcut.session import shared_dir
from tests.conftest import SF01

CNT = ("count", "*", "cnt")


@pytest.fixture(scope="module")
def constant(spark):
    """Value 5 everywhere, two groups, a filter on 2 % of the rows."""
    return spark.range(50_000).select("id", (F.col("id") % 2).alias("g"), F.lit(5.0).alias("v"),
                                      (F.xxhash64("id") % 50).alias("m")).withColumn("m", F.col("m") == 0)


def test_constant_values_under_a_filter_have_a_margin(spark, constant):
    st = SampleStore(spark, shared_dir(spark, "t-filtered-sum"))
    st.build_stratified(constant, "t", "g", "id", 0.05)
    exact = {r.g: r.s for r in exact_aggregate(constant, [("sum", "v", "s")], ["g"], F.col("m")).collect()}
    for r in st.stratified_aggregate("t", "g", [("sum", "v", "s")], "m").collect():
        assert r.s_error_pct > 20 and r.s_ci_low < exact[r.g] < r.s_ci_high
    for r in stratified.stratified_aggregate(constant, "g", [("sum", "v", "s")], 0.05, "id", "m").collect():
        assert r.s_error_pct > 20 and r.s_ci_low < exact[r.g] < r.s_ci_high
    res, plan = approx_aggregate(constant, ["sum(v)"], ["g"], accuracy=0.99, where="m", table="t", store=st,
                                 return_plan=True)
    assert plan.strategy == "exact" and {r.g: r.sum_v for r in res.collect()} == exact
    # without a filter a constant is known
    res, plan = approx_aggregate(constant, ["sum(v)"], ["g"], accuracy=0.99, table="t", store=st, return_plan=True)
    assert plan.strategy == "materialized_stratified"
    assert {r.g: r.sum_v for r in res.collect()} == {0: 125_000.0, 1: 125_000.0}


def test_filtered_sums_cover(spark):
    """95 % intervals of a 2 % filter over 24 salts and 6 strata."""
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select(
        "l_returnflag", "l_linestatus", "l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    salted = li.withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(24))))
    g = ["salt", "l_returnflag", "l_linestatus"]
    where, aggs = "l_partkey % 50 = 7", [("sum", "l_extendedprice", "s"), ("avg", "l_extendedprice", "a")]
    est = stratified.stratified_aggregate(salted, g, aggs, 0.25, ["salt", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
                                          where, hash_method="xxhash")
    ex = exact_aggregate(salted, [("sum", "l_extendedprice", "xs"), ("avg", "l_extendedprice", "xa")], g, F.expr(where))
    rows = join_on_groups(est, ex, g).where("xs IS NOT NULL").collect()
    hits = sum(r.s_ci_low <= r.xs <= r.s_ci_high for r in rows)
    means = sum(r.a_ci_low is not None and r.a_ci_low <= r.xa <= r.a_ci_high for r in rows)
    assert len(rows) >= 96 and hits >= 0.93 * len(rows) and means >= 0.9 * len(rows)


def test_spread_of_value_times_match(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 4, 8)], "v double")
    got = df.agg(F.sum("v").alias("s"), F.stddev_samp("v").alias("sd"), F.count("v").alias("k")).select(
        F.expr(bounds.domain_spread_sql("s", "sd", "k", 10)).alias("x")).first().x
    want = spark.createDataFrame([(float(v),) for v in (3, 4, 8, 0, 0, 0, 0, 0, 0, 0)], "v double").agg(F.stddev_samp("v")).first()[0]
    assert got == pytest.approx(want)


def test_nothing_matched_is_bounded_by_the_extremes(spark):
    df = spark.range(4000).select("id", F.lit("g").alias("g"), (F.col("id") % 7 - 2).cast("double").alias("v"))
    for res in (stratified.stratified_aggregate(df, "g", [("sum", "v", "s")], 0.05, "id", "id < 0"),
                _stored(spark, df, "t-none").stratified_aggregate("t", "g", [("sum", "v", "s")], "id < 0")):
        r = res.first()
        assert r.s == 0 and r.s_error_pct is None
        assert r.s_ci_high > 0 > r.s_ci_low and r.s_ci_high == pytest.approx(-2 * r.s_ci_low)  # values -2 to 4


def test_a_stratum_sampled_as_a_whole_is_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    for r in stratified.stratified_aggregate(df, "g", [("sum", "v", "s")], 1.0, "id", "id % 10 = 0").collect():
        assert r.s_error_pct == 0.0 and r.s_ci_low == r.s == r.s_ci_high


def test_null_values_count_as_nothing(spark):
    df = spark.range(20_000).select("id", F.lit(1).alias("g"), F.when(F.col("id") % 4 == 0, F.lit(2.0)).alias("v"))
    r = stratified.stratified_aggregate(df, "g", [("sum", "v", "s"), ("avg", "v", "a")], 0.05, "id").first()
    assert r.s_ci_low < 10_000 < r.s_ci_high and r.s_error_pct > 5
    assert r.a == 2.0 and r.a_ci_low == 2.0


def _stored(spark, df, name):
    st = SampleStore(spark, shared_dir(spark, name))
    st.build_stratified(df, "t", "g", "id", 0.05)
    return st


# ------------------------------------------------------------------ lost groups
@pytest.fixture(scope="module")
def even(spark):
    """Eight large groups and one of four rows."""
    return spark.range(100_000).select("id", F.when(F.col("id") < 4, 99).otherwise(F.col("id") % 8).alias("g"))


@pytest.mark.parametrize("where", [None, "id % 3 = 0"])
def test_planner_keeps_every_group(spark, even, where):
    st = SampleStore(spark, shared_dir(spark, f"t-groups-{where is None}"))
    st.build_tiers(even, "t", "id")
    res, plan = approx_aggregate(even, [CNT], ["g"], accuracy=0.95, table="t", store=st, where=where, return_plan=True)
    exact = {r.g: r.cnt for r in exact_aggregate(even, [CNT], ["g"], None if where is None else F.expr(where)).collect()}
    assert plan.strategy == "exact" and {r.g: r.cnt for r in res.collect()} == exact
    st.build_tiers(even, "t", "id", known_groups=[["g", "id"], ["g"]])
    res, plan = approx_aggregate(even, [CNT], ["g"], accuracy=0.95, table="t", store=st, where=where, return_plan=True)
    assert set(exact) <= {r.g for r in res.collect()}
    # large groups alone keep the target from the tier
    res, plan = approx_aggregate(even.where("g < 99"), [CNT], ["g"], accuracy=0.95, table="u", store=_tiers(spark, even, st),
                                 return_plan=True)
    assert plan.strategy == "materialized_tier" and {r.g for r in res.collect()} == set(range(8))


def _tiers(spark, even, st):
    st.build_tiers(even.where("g < 99"), "u", "id", known_groups=[["g"]])
    return st


def test_tier_answer_names_missed_groups(spark, even):
    st = SampleStore(spark, shared_dir(spark, "t-missed"))
    st.build_tiers(even, "t", "id", known_groups=[["g"]])
    got = {r.g: r for r in st.tier_aggregate("t", [CNT, ("sum", "id", "s")], 0.01, group_by=["g"], where="g = 99").collect()}
    assert set(got) == {*range(8), 99}
    assert got[0].cnt == 0 and got[0].s == 0.0 and got[0].cnt_error_pct is None and 250 < got[0].cnt_ci_high < 350


def test_runtime_sample_keeps_every_group(spark, even):
    got = {r.g: r.cnt for r in sampling.sample_aggregate(even, [CNT], 0.01, ["g"], key="id", all_groups=True,
                                                         hash_method="xxhash").collect()}
    assert set(got) == {*range(8), 99}


def test_compared_tiers_show_missed_groups(spark, even):
    st = SampleStore(spark, shared_dir(spark, "t-compare"))
    st.build_tiers(even, "t", "id", known_groups=[["g"]])
    rows = compare_strategies(even, [CNT], ["g"], 0.01, key="id", table="t", store=st).where(
        "strategy = 'materialized_tier'").collect()
    assert len(rows) == 9 and all(r.supported for r in rows)


def test_block_answer_takes_all_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 8000, 1, 8).select((F.col("id") / 1000).cast("int").alias("g"), "id").write.parquet(path)
    groups = spark.range(8).select(F.col("id").cast("int").alias("g"))
    s = block_sample(spark, path, 0.25)
    assert block_aggregate(s, [CNT], ["g"]).count() == 2
    rows = {r.g: r for r in block_aggregate(s, [CNT], ["g"], groups=groups).collect()}
    assert len(rows) == 8 and sum(r.cnt == 0 and r.cnt_ci_high is None for r in rows.values()) == 6


def test_columns_with_commas(spark):
    st = SampleStore(spark, shared_dir(spark, "t-commas"))
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("a,b"), F.col("id").alias("k,1"))
    st.build_tiers(df, "t", "k,1")
    st.build_stratified(df, "t", ["a,b"], "k,1", 0.1)
    assert st.stratified_groups("t") == [("a,b",)]
    st.refresh("t", df)
    assert st.stratified_aggregate("t", ["a,b"], [CNT]).count() == 3
