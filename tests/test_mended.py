"""Inputs that once gave wrong answers: NULL keys, NaN, ties, large means, rebuilt samples,
selective filters, missing shared storage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roughcut import session
from roughcut.functions import bounds
from roughcut.operators import profile as prof
from roughcut.operators import quantile, sampling, sketches, stratified
from roughcut.operators.quantile import exact_quantiles, exact_quantiles_grouped
from roughcut.operators.samples import SampleStore
from roughcut.plans.aggregate import approx_aggregate, exact_aggregate
from roughcut.session import shared_dir

CNT = ("count", "*", "cnt")


def jobs_of(spark, fn):
    """Result and number of Spark jobs that ``fn`` starts."""
    sc = spark.sparkContext
    group = f"count-{id(fn)}"
    sc.setJobGroup(group, "count")
    try:
        out = fn()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(group))


# ------------------------------------------------------------------ NULL keys
@pytest.mark.parametrize("method", ["md5", "xxhash"])
def test_rows_without_key_are_sampled(spark, method):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.lit(1.0).alias("v"))
    r = sampling.sample_aggregate(df, [CNT, ("sum", "v", "s")], 1.0, key="k", hash_method=method).first()
    assert (r["cnt"], r["s"]) == (1000, 1000.0)
    kept = sampling.uniform_sample(df, 0.3, "k", hash_method=method)
    assert kept.filter("k IS NULL").count() in (0, 500)  # rows of one (missing) key go together
    assert 100 < kept.filter("k IS NOT NULL").count() < 200


def test_hash_sampling_without_key_raises(spark):
    df = spark.range(10)
    with pytest.raises(ValueError, match="key"):
        sampling.uniform_sample(df, 0.5)
    assert sampling.uniform_sample(df, 1.0, method="bernoulli").count() == 10
    for rows in (df.withColumn("g", F.col("id") % 2), df.withColumn("g", F.lit(1))):  # even and one-sided
        with pytest.raises(ValueError, match="key"):
            approx_aggregate(rows, ["sum(id)"], ["g"], runtime_sampling=True)


def test_stratum_of_null_keys_is_represented_once(spark):
    df = spark.range(2000).select(F.when(F.col("id") >= 100, F.col("id")).alias("k"),
                                  F.when(F.col("id") < 100, "none").otherwise("some").alias("g"))
    for limit in (1000, 0):  # empty strata broadcast, or carried by the aggregate
        rows = stratified.stratified_sample(df, "g", 0.01, key="k", broadcast_bytes=limit)
        assert rows.filter("g = 'none'").count() in (1, 100)
    r = {x["g"]: x for x in stratified.stratified_aggregate(df, "g", [CNT], 0.01, key="k").collect()}
    assert r["none"]["cnt"] == 100 and r["none"]["sample_count"] >= 1


def test_filtered_strata_stay_with_an_upper_bound(spark):
    df = spark.range(10_050).select("id", F.when(F.col("id") < 50, "rare").otherwise("big").alias("g"))
    got = stratified.stratified_aggregate(df, "g", [CNT, ("sum", "id", "s")], 0.02, key="id", where="id % 25 = 3")
    r = {x["g"]: x for x in got.collect()}
    assert set(r) == {"rare", "big"}
    assert r["rare"]["cnt_ci_low"] <= 2 <= r["rare"]["cnt_ci_high"]
    assert r["big"]["cnt_ci_low"] <= 400 <= r["big"]["cnt_ci_high"]


def test_stored_strata_stay_under_a_filter(spark):
    df = spark.range(3000).select("id", (F.col("id") % 30).cast("string").alias("g"))
    st = SampleStore(spark, shared_dir(spark, "test", "mended-strata"))
    st.build_stratified(df, "t", "g", "id", 0.02)
    got = st.stratified_aggregate("t", "g", [CNT], where=F.col("id") < 60).collect()
    assert len(got) == 30 and all(r["cnt_ci_high"] > 0 for r in got)
    assert sum(r["cnt_ci_low"] <= 2 <= r["cnt_ci_high"] for r in got) >= 26  # 95 % intervals


def test_wilson_interval_leaves_room_at_both_ends(spark):
    for hits, n, N, lo, hi in ((1, 1, 100, 1, 100), (0, 10, 1000, 0, 300), (10, 10, 1000, 700, 1000), (7, 20, 20, 7, 7)):
        b = bounds.domain_count_interval_sql(hits, n, N)
        r = spark.range(1).selectExpr(f"{b['ci_low']} AS lo", f"{b['ci_high']} AS hi").first()
        assert lo <= r["lo"] <= r["hi"] <= hi, (hits, n, N, r)
        assert n == N or r["lo"] < r["hi"]


# ------------------------------------------------------------------ quantiles
PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)


def frames(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    half = np.where(rng.random(n) < 0.5, 0.0, rng.normal(size=n))
    third = np.where(rng.random(n) < 0.33, np.nan, rng.normal(size=n))
    few = rng.integers(0, 4, n).astype(float)
    wild = rng.normal(size=n)
    wild[:5], wild[5:9] = np.inf, -np.inf
    for name, x in (("half zero", half), ("third NaN", third), ("four values", few), ("infinities", wild),
                    ("all NaN", np.full(300, np.nan)), ("constant", np.full(n, 7.5))):
        yield name, x, spark.createDataFrame([(float(v), i % 3 if i % 50 else None) for i, v in enumerate(x)],
                                             "x double, g int").repartition(4)


def expected(x, p, kind):
    s = np.sort(x)  # NaN last, as SQL
    if kind == "disc":
        return s[max(1, math.ceil(p * len(s))) - 1]
    pos = p * (len(s) - 1)
    a, b = s[math.floor(pos)], s[math.ceil(pos)]
    return a if a == b or pos == math.floor(pos) else (math.ceil(pos) - pos) * a + (pos - math.floor(pos)) * b


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, abs=1e-12)


def test_selection_with_ties_nan_and_infinities(spark, monkeypatch):
    left = []
    read = quantile._read
    monkeypatch.setattr(quantile, "_read", lambda vals, b: left.extend(x.size for x in b) or read(vals, b))
    for name, x, df in frames(spark):
        for kind in ("cont", "disc"):
            got = exact_quantiles(df, "x", PROBS, kind, small=100, k=200).first()
            assert all(same(g, expected(x, p, kind)) for g, p in zip(got, PROBS)), (name, kind, got)
    assert max(left) <= 100  # rows, not only distinct values, that the last window may see


@pytest.mark.parametrize("small", [100, 100_000])  # by rounds, and in one step
@pytest.mark.parametrize("kind", ["cont", "disc"])
def test_grouped_selection_with_ties_and_nan(spark, small, kind):
    for name, x, df in frames(spark):
        got = exact_quantiles_grouped(df, "g", "x", PROBS, kind, names=[f"q{i}" for i in range(len(PROBS))],
                                      small=small, k=200).collect()
        group = np.array([i % 3 if i % 50 else -1 for i in range(len(x))])
        assert len(got) == len(set(group))
        for r in got:
            own = x[group == (-1 if r["g"] is None else r["g"])]
            assert all(same(r[f"q{i}"], expected(own, p, kind)) for i, p in enumerate(PROBS)), (name, r)


def test_no_values(spark):
    df = spark.createDataFrame([(None, 1)], "x double, g int")
    assert tuple(exact_quantiles(df, "x", (0.5, 0.9)).first()) == (None, None)
    assert exact_quantiles_grouped(df, "g", "x", (0.5,)).collect() == []


# ------------------------------------------------------------------ profile
def test_spread_of_a_column_with_a_large_mean(spark):
    df = spark.range(0, 4000, 1, 7).select((1.7e9 + F.col("id") % 2).alias("x"), F.lit(None).cast("double").alias("n"),
                                           F.when(F.col("id") == 3, 5.0).alias("one"))
    r = {x["column_name"]: x for x in prof.profile_table(df).collect()}
    assert r["x"]["stddev"] == pytest.approx(0.50006, abs=1e-4) and r["x"]["mean"] == pytest.approx(1.7e9 + 0.5)
    assert r["n"]["mean"] is None and r["n"]["stddev"] is None
    assert r["one"]["mean"] == 5.0 and r["one"]["stddev"] is None


def test_histogram_of_nan_and_infinity(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, float("nan"), inf, -inf, None)], "x double")
    h = prof.histogram(df, "x", bins=2).orderBy("bin").collect()
    assert [(r["count"], r["bin_lo"], r["bin_hi"], r["non_finite"]) for r in h] == [(1, 1.0, 2.0, 3), (2, 2.0, 3.0, 3)]


@pytest.mark.parametrize("mean,sd,n", [(5.0, None, 100), (None, 2.0, 100), (5.0, 2.0, 0), (5.0, 2.0, 400), (0.0, 1.0, 9),
                                       (5.0, 400.0, 10)])
def test_rate_twins_agree(spark, mean, sd, n):
    df = spark.createDataFrame([(0.95, mean, sd, n)], "a double, m double, s double, n long")
    assert df.select(bounds.accuracy_to_rate("a", "m", "s", "n")).first()[0] == \
        pytest.approx(bounds.accuracy_to_rate_py(0.95, mean, sd, n))


# ------------------------------------------------------------------ stored samples and planner
@pytest.fixture(scope="module")
def store(spark):
    base = spark.range(60_000).select("id", (F.col("id") % 97).cast("double").alias("v"),
                                      (F.col("id") % 3).cast("string").alias("g"))
    st = SampleStore(spark, shared_dir(spark, "test", "mended-planner"))
    st.build_tiers(base, "t", "id", known_groups=[["g"]])
    return st, base


def test_newest_build_replaces_all_tiers(spark):
    st = SampleStore(spark, shared_dir(spark, "test", "mended-tiers"))
    st.build_tiers(spark.range(10_000), "t", "id")
    st.build_tiers(spark.range(50_000), "t", "id", rates=(0.05,))
    assert st.available_tiers("t") == [0.05]
    assert st.tier_aggregate("t", [CNT], rate=0.05).first()["cnt"] == 50_000


def test_count_from_a_tier_plans_without_a_job(spark, store):
    st, base = store
    st._registry_rows()  # read once a session
    (_, plan), jobs = jobs_of(spark, lambda: approx_aggregate(base, [CNT], accuracy=0.9, table="t", store=st,
                                                              return_plan=True))
    assert plan.strategy == "materialized_tier" and jobs <= 1  # at most the file listing


def test_sketch_request_scans_once(spark, store):
    _, base = store
    aggs = [("sum", "v", "s"), ("percentile", "v", "a", 0.5), ("percentile", "v", "b", 0.9), ("percentile", "v", "c", 0.99),
            ("count_distinct", "id", "d")]
    res = approx_aggregate(base, aggs)
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Exchange") <= 2
    r = res.first()
    assert r["s"] == base.agg(F.sum("v")).first()[0] and abs(r["d"] - 60_000) < 60_000 * 0.03 and abs(r["a"] - 48) <= 1


def test_target_is_kept_or_the_answer_is_exact(spark, store):
    st, base = store
    for accuracy in (0.8, 0.9, 0.95, 0.99, 0.999):
        for where in (None, F.col("id") % 50 == 0, F.col("id") < 0):
            r, plan = approx_aggregate(base, [CNT, ("avg", "v", "m")], accuracy=accuracy, where=where, table="t", store=st,
                                       return_plan=True)
            r = r.first()
            if plan.strategy == "exact":
                assert r["cnt"] == (base if where is None else base.filter(where)).count()
            else:
                assert max(r["cnt_error_pct"], r["m_error_pct"]) <= 100 * (1 - accuracy) + 1e-6


def test_grouped_answer_from_tiers(spark, store):
    st, base = store
    r, plan = approx_aggregate(base, [CNT], ["g"], accuracy=0.9, table="t", store=st, return_plan=True)
    assert plan.strategy == "materialized_tier" and r.count() == 3
    assert all(abs(x["cnt"] - 20_000) < 2000 for x in r.collect())


def test_default_is_exact_without_stored_samples(spark, store):
    _, base = store
    r, plan = approx_aggregate(base, [CNT], ["g"], return_plan=True)
    assert plan.strategy == "exact" and {x["cnt"] for x in r.collect()} == {20_000}
    _, plan = approx_aggregate(spark.range(50).withColumn("v", F.rand(1) * 1e6), [("avg", "v", "m")], key="id",
                               runtime_sampling=True, accuracy=0.999, return_plan=True)
    assert plan.strategy == "exact"  # the target needs more than the largest rate


def test_quantile_size_follows_the_target(spark, store):
    _, base = store
    sizes = [approx_aggregate(base, [("median", "v", "m")], accuracy=a, return_plan=True)[1].quantile_k
             for a in (0.85, 0.95, 0.99)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]
    assert approx_aggregate(base, [("median", "v", "m")], quantile_k=300, return_plan=True)[1].quantile_k == 300


def test_no_plan_groups_by_the_counted_column(spark, store):
    _, base = store
    plan = sketches.approx_distinct(base, "id", rsd=0.01)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[id" not in plan
    assert sketches.precision_for(0.04) == 10 and sketches.hll_error_pct(sketches.precision_for(0.005)) <= 0.5


# ------------------------------------------------------------------ shared storage
def test_cluster_without_shared_folder_raises():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_repeated_queries_write_nothing_new(spark):
    from roughcut.suite import _WRITTEN, QUERIES
    from tests.conftest import SF001
    QUERIES["materialized_agg"](spark, SF001).collect()
    before = dict(_WRITTEN)
    for name in ("materialized_agg", "materialized_filter", "materialized_group", "sample_registry"):
        QUERIES[name](spark, SF001).collect()
    assert _WRITTEN == before


def test_exact_quantiles_of_several_columns(spark, store):
    _, base = store
    r = exact_aggregate(base, [("median", "v", "a"), ("percentile", "v", "b", 0.9), ("median", "id", "c")]).first()
    assert (r["a"], r["c"]) == (48.0, 29_999.5) and r["b"] == pytest.approx(87.0, abs=1)


# ------------------------------------------------------------------ block samples
def test_block_sample_reads_only_its_files(spark):
    from roughcut.operators.blocks import block_aggregate, block_sample
    path = shared_dir(spark, "test", "mended-blocks")
    spark.range(0, 40_000, 1, 40).select("id", (F.col("id") % 7).cast("double").alias("v"),
                                         F.when(F.col("id") < 10, "rare").otherwise("big").alias("g")) \
        .write.mode("overwrite").parquet(path)
    s = block_sample(spark, path, 0.1)
    assert (s.chosen, s.files) == (4, 40) and len(s.rows.inputFiles()) == 4 and s.rows.count() == 4000
    again = block_sample(spark, path, 0.1)
    assert sorted(again.rows.inputFiles()) == sorted(s.rows.inputFiles())
    r = block_aggregate(s, [CNT, ("sum", "v", "s"), ("avg", "v", "m")]).first()
    assert r["cnt"] == 40_000 and abs(r["m"] - 3) < 0.01 and abs(r["s"] - 120_000) < 500
    whole = block_aggregate(block_sample(spark, path, 1.0), [CNT], ["g"]).collect()
    assert {x["g"]: (x["cnt"], x["cnt_error_pct"]) for x in whole} == {"rare": (10, 0.0), "big": (39_990, 0.0)}


def test_block_intervals_cover(spark):
    from roughcut.operators.blocks import block_aggregate, block_sample
    path = shared_dir(spark, "test", "mended-clusters")
    df = spark.range(0, 20_000, 1, 50).select("id", (F.col("id") % 400 + F.rand(3)).alias("v"))
    df.write.mode("overwrite").parquet(path)
    truth = spark.read.parquet(path).agg(F.sum("v"), F.avg("v"), F.count_if(F.col("v") < 100)).first()
    hit = 0
    for salt in range(20):
        s = block_sample(spark, path, 0.3, salt=str(salt))
        r = block_aggregate(s, [("sum", "v", "s"), ("avg", "v", "m")]).first()
        c = block_aggregate(s, [CNT], where=F.col("v") < 100).first()
        hit += (r["s_ci_low"] <= truth[0] <= r["s_ci_high"]) + (r["m_ci_low"] <= truth[1] <= r["m_ci_high"]) \
            + (c["cnt_ci_low"] <= truth[2] <= c["cnt_ci_high"])
    assert hit >= 50  # 95 % of 60, with room for small samples


def test_repeated_request_is_planned_without_data(spark, store):
    st, base = store
    ask = dict(accuracy=0.9, table="t", store=st, return_plan=True)
    first, plan = approx_aggregate(base, [("avg", "v", "m")], **ask)
    (again, same_plan), jobs = jobs_of(spark, lambda: approx_aggregate(base, [("avg", "v", "m")], **ask))
    assert jobs == 0 and same_plan.strategy == plan.strategy
    assert again.first()["m"] == first.first()["m"]
    st._invalidate()  # as a rebuild does
    assert not st.decisions
