"""Priority samples, join-key samples, spread-aware strata and samples that follow their files."""

import math

import pytest
from pyspark.sql import functions as F

from roughcut.functions.ranking import numbered
from roughcut.operators import stratified, upkeep
from roughcut.operators.allocation import allocate, allocated_aggregate, allocated_sample
from roughcut.operators.priority import priority_aggregate, priority_sample, sum_bound_pct
from roughcut.operators.samples import SampleStore
from roughcut.operators.universe import universe_join_aggregate, universe_sample
from roughcut.session import shared_dir
from tests.conftest import SF01

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@pytest.fixture(scope="module")
def skewed(spark):
    """Weights over six orders of magnitude, some 0, NULL and NaN."""
    i = F.col("id")
    return spark.range(20_000).select("id", (i % 4).alias("g"), F.when(i % 50 == 0, F.lit(0.0)).when(i % 51 == 0, F.lit(None))
                                      .when(i % 53 == 0, F.lit(float("nan"))).otherwise(F.exp((i * 7919 % 1000) / 72)).alias("v"))


# ------------------------------------------------------------------ priority
def test_priority_sample_is_exact_in_size_and_repeatable(spark, skewed):
    first = {r.id for r in priority_sample(skewed, 300, "v", "id").collect()}
    again = {r.id for r in priority_sample(skewed.repartition(13), 300, "v", "id").collect()}
    assert len(first) == 300 and first == again
    # equal keys and weights beyond measure still give k rows
    same = spark.range(5000).select(F.lit(1).alias("id"), F.lit(2.0).alias("v"))
    assert priority_sample(same, 100, "v", "id").count() == 100
    small = priority_sample(skewed.where("id < 10 AND v > 0"), 300, "v", "id").collect()
    assert len(small) == 9 and all(r.inclusion == 1.0 for r in small)
    assert priority_sample(skewed.limit(0), 5, "v", "id").collect() == []
    with pytest.raises(ValueError):
        priority_sample(skewed, 0, "v", "id")


def test_priority_sums_cover_and_beat_a_uniform_sample(spark, skewed):
    """6 salts: 95 % intervals of the groups' sums hold the truth, and the total stays within
    the bound that depends on k alone."""
    clean = skewed.where("v > 0 AND NOT isnan(v)")
    exact = {r.g: r.s for r in clean.groupBy("g").agg(F.sum("v").alias("s")).collect()}
    total, hits, worst = sum(exact.values()), 0, 0.0
    for salt in range(6):
        s = priority_sample(clean.withColumn("salt", F.lit(salt)), 400, "v", ["salt", "id"], hash_method="xxhash")
        rows = priority_aggregate(s, [("sum", "v", "s")], ["g"]).collect()
        hits += sum(r.s_ci_low <= exact[r.g] <= r.s_ci_high for r in rows)
        worst = max(worst, abs(sum(r.s for r in rows) / total - 1))
    assert hits >= 0.85 * 24 and 100 * worst <= 1.5 * sum_bound_pct(400)
    assert sum_bound_pct(401) == pytest.approx(100 * 1.96 / 20) and math.isinf(sum_bound_pct(1))


def test_priority_counts_and_averages(spark):
    df = spark.range(50_000).select("id", (1 + F.col("id") % 10).cast("double").alias("w"), (F.col("id") % 100).alias("x"))
    r = priority_aggregate(priority_sample(df, 2000, "w", "id"), [("count", "*", "c"), ("avg", "x", "a"), ("sum", "w", "s")],
                           where="x < 50").first()
    assert r.c_ci_low < 25_000 < r.c_ci_high and r.a_ci_low < 24.5 < r.a_ci_high and r.s_ci_low < 25_000 * 5.5 < r.s_ci_high
    assert r.c_error_pct < 10 and r.s_error_pct < 8


def test_stored_priority_sample(spark, skewed):
    st = SampleStore(spark, shared_dir(spark, "t-priority"))
    st.build_priority(skewed, "t", 200, "v", "id")
    assert st.priority("t", "v").count() == 200 and st.available_tiers("t") == []
    st.build_tiers(skewed, "t", "id")
    assert st.registry().where("sample_type = 'priority'").first().sample_rows == 200
    st.refresh("t", skewed.where("id < 10000"))
    assert st.priority("t", "v").agg(F.max("id")).first()[0] < 10000 and len(st.available_tiers("t")) == 3


# ------------------------------------------------------------------ join keys
@pytest.fixture(scope="module")
def joined(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    return li, spark.read.parquet(f"{SF01}/orders.parquet")


def test_join_estimates_cover(joined):
    li, orders = joined
    exact = {r.p: (r.c, r.s) for r in li.join(orders, li.l_orderkey == orders.o_orderkey).groupBy(
        F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("c"), F.sum("l_extendedprice").alias("s")).collect()}
    hits = n = 0
    for salt in range(6):
        rows = universe_join_aggregate(li, orders, "l_orderkey", "o_orderkey", 0.1, [("count", "*", "c"), ("sum", "l_extendedprice", "s")],
                                       ["o_orderpriority"], salt=f"s{salt}").collect()
        for r in rows:
            c, s = exact[r.o_orderpriority]
            hits += (r.c_ci_low <= c <= r.c_ci_high) + (r.s_ci_low <= s <= r.s_ci_high)
            n += 2
    assert n == 60 and hits >= 0.9 * n


def test_join_samples_keep_whole_keys_and_filter_both_scans(joined):
    li, orders = joined
    got = universe_sample(li, "l_orderkey", 0.1).join(universe_sample(orders, "o_orderkey", 0.1),
                                                      F.col("l_orderkey") == F.col("o_orderkey"))
    kept = {r.l_orderkey: r.n for r in got.groupBy("l_orderkey").agg(F.count("*").alias("n")).collect()}
    whole = {r.l_orderkey: r.n for r in li.join(orders, li.l_orderkey == orders.o_orderkey).groupBy("l_orderkey").agg(
        F.count("*").alias("n")).collect()}
    assert all(whole[k] == n for k, n in kept.items()) and 0.07 < len(kept) / len(whole) < 0.13
    plan = universe_join_aggregate(li, orders, "l_orderkey", "o_orderkey", 0.1, ["count(*)"])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Join"):]
    assert below.count("md5") >= 2 and below.count("FileScan") == 2


def test_join_of_everything_is_exact(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0), (None, 7.0)], "k long, x double")
    b = spark.createDataFrame([(1, "p"), (1, "q"), (3, "p"), (None, "p")], "j long, g string")
    r = universe_join_aggregate(a, b, "k", "j", 1.0, [("count", "*", "c"), ("sum", "x", "s"), ("avg", "x", "a")]).first()
    assert (r.c, r.s, r.a, r.sample_keys) == (4, 10.0, 2.5, 1) and r.s_ci_low == r.s_ci_high == 10.0
    r = universe_join_aggregate(a.limit(0), b, "k", "j", 0.5, [("sum", "x", "s")]).first()
    assert r.s == 0.0 and r.sample_keys == 0


def test_stored_join_samples(spark, joined):
    li, orders = joined
    st = SampleStore(spark, shared_dir(spark, "t-universe"))
    st.build_universe(li, "li", "l_orderkey", 0.3)
    st.build_universe(orders, "o", "o_orderkey", 0.2)
    aggs = [("sum", "l_extendedprice", "s")]
    got = st.join_aggregate("li", "o", "l_orderkey", "o_orderkey", aggs).first()
    want = universe_join_aggregate(li, orders, "l_orderkey", "o_orderkey", 0.2, aggs).first()
    assert got.s == pytest.approx(want.s) and got.sample_keys == want.sample_keys
    with pytest.raises(LookupError):
        st.universe("li", "l_partkey")


# ------------------------------------------------------------------ allocation
def test_allocation_keeps_budget_floor_and_aim(spark):
    i = F.col("id")
    df = spark.range(60_000).select("id", F.when(i < 30, 0).when(i < 3000, 1).when(i < 30_000, 2).otherwise(3).alias("g"),
                                    F.when(i >= 30_000, F.lit(7.0)).otherwise((i % 97).cast("double")).alias("v"))
    for aim in ("groups", "total"):
        st = {r.g: r for r in allocate(df, "g", "v", 2000, aim).collect()}
        assert sum(r.target_rows for r in st.values()) == pytest.approx(2000, abs=2)
        assert st[3].target_rows == 20  # nothing varies there
        assert all(20 <= r.target_rows <= r.population_count for r in st.values())
        if aim == "total":
            assert st[2].target_rows > 8 * st[1].target_rows * 0.9
    with pytest.raises(ValueError):
        allocate(df, "g", "v", 50)
    with pytest.raises(ValueError):
        allocate(df, "g", "v", 1000, "neither")
    assert allocate(df.limit(0), "g", "v", 10).collect() == []


def test_allocated_margins_beat_one_rate_and_cover(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").withColumn(
        "grp", F.floor(F.log2(F.greatest("l_partkey", F.lit(1)))).cast("int"))
    aggs = [("sum", "l_extendedprice", "s"), ("avg", "l_quantity", "a"), ("count", "*", "c")]
    strata = allocate(li, "grp", "l_extendedprice", 3000)
    exact = {r.grp: r for r in li.groupBy("grp").agg(F.sum("l_extendedprice").alias("s"), F.avg("l_quantity").alias("a"),
                                                    F.count("*").alias("c")).collect()}
    hits = 0
    for salt in range(4):
        rows = allocated_aggregate(allocated_sample(li.withColumn("salt", F.lit(salt)), strata, "grp", ["salt", *KEY], hash_method="xxhash"),
                                   "grp", aggs).collect()
        assert {r.grp for r in rows} == set(exact) and all(r.c == exact[r.grp].c and r.sample_count >= 2 for r in rows)
        hits += sum(r.s_ci_low - 0.01 <= exact[r.grp].s <= r.s_ci_high + 0.01 for r in rows)
    assert hits >= 0.9 * 4 * len(exact)
    equal = stratified.stratified_aggregate(li, "grp", aggs, 0.05, KEY).collect()
    assert max(r.s_error_pct for r in rows) < 0.5 * max(r.s_error_pct or 1e9 for r in equal)


def test_strata_get_two_rows_even_where_the_threshold_takes_none(spark):
    df = spark.range(500).select("id", (F.col("id") % 5).alias("g"), F.lit(1.0).alias("v"))
    strata = allocate(df, "g", "v", 100).withColumn("threshold", F.lit(0).cast("long"))
    got = allocated_sample(df, strata, "g", "id").groupBy("g").count().collect()
    assert sorted((r.g, r["count"]) for r in got) == [(g, 2) for g in range(5)]
    one = df.where("id = 3").unionByName(df.where("g = 1"))
    strata = allocate(one, "g", "v", 50, least_rows=2)
    assert {r.g for r in allocated_sample(one, strata, "g", "id").collect()} == {1, 3}


# ------------------------------------------------------------------ upkeep
def _rows(spark, a, b):
    i = F.col("id")
    return spark.range(a, b, 1, 3).select("id", (i % 7).cast("int").alias("g"), F.when(i % 997 == 0, F.lit("rare")).when(
        i == 8500, F.lit(None)).otherwise("often").alias("s"), (i % 13).cast("double").alias("v"))


def test_appends_read_new_files_only_and_equal_a_rebuild(spark, tmp_path, monkeypatch):
    path, read = str(tmp_path / "t"), []
    _rows(spark, 0, 5000).write.parquet(path)
    st = SampleStore(spark, str(tmp_path / "samples"))
    real = upkeep.new_rows
    monkeypatch.setattr(upkeep, "new_rows", lambda s, p, files: read.append(real(s, p, files).inputFiles()) or real(s, p, files))
    strata = [(["s"], 0.001), (["g", "s"], 0.05)]
    upkeep.build_from_files(st, path, "t", "id", strata=strata, known_groups=[["g"]])
    before = set(spark.read.parquet(path).inputFiles())
    for a, b, most in ((5000, 8000, 16), (8000, 9000, 2)):
        _rows(spark, a, b).write.mode("append").parquet(path)
        done = upkeep.append_files(st, path, "t", max_parts=most)
        assert len(done.files) == 3 and not done.rebuilt and not set(read[-1]) & before
        before |= set(read[-1])
    full, df = SampleStore(spark, str(tmp_path / "full")), spark.read.parquet(path)
    full.build_tiers(df, "t", "id")
    for g, rate in strata:
        full.build_stratified(df, "t", g, "id", rate)
    for f in (lambda s: s.tier("t", 0.2), lambda s: s.tier("t", 0.005), lambda s: s.stratified_rows("t", ["s"]),
              lambda s: s.stratified_rows("t", ["g", "s"]), lambda s: s.strata("t", ["s"]), lambda s: s.strata("t", ["g", "s"]),
              lambda s: s.stratified_aggregate("t", ["g", "s"], [("sum", "v", "x"), ("count", "*", "c")], "id % 3 = 0")):
        got, want = f(st), f(full)
        cols = sorted(want.columns)
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    kinds = ["sample_type", "sample_rows", "population_rows"]
    assert sorted(map(tuple, st.registry().select(kinds).collect())) == sorted(map(tuple, full.registry().select(kinds).collect()))
    assert {r.g for r in st.known_groups("t", ["g"]).collect()} == set(range(7))
    # nothing new: nothing is read; superseded versions can go
    assert upkeep.append_files(st, path, "t").files == [] and len(read) == 3
    assert st.vacuum("t") and st.tier("t", 0.2).count() == full.tier("t", 0.2).count()


def test_removed_files_raise_or_rebuild(spark, tmp_path):
    path = str(tmp_path / "t")
    _rows(spark, 0, 3000).write.parquet(path)
    st = SampleStore(spark, str(tmp_path / "samples"))
    upkeep.build_from_files(st, path, "t", "id", strata=[(["g"], 0.05)])
    _rows(spark, 0, 2000).write.mode("overwrite").parquet(path)
    with pytest.raises(upkeep.SourceChanged):
        upkeep.append_files(st, path, "t")
    assert st.registry().first().population_rows == 3000
    assert upkeep.append_files(st, path, "t", rebuild=True).rebuilt
    assert {r.population_rows for r in st.registry().collect()} == {2000}
    assert st.tier("t", 0.2).agg(F.max("id")).first()[0] < 2000
    with pytest.raises(LookupError):
        upkeep.append_files(st, path, "other")


def test_numbered_counts_every_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("o"))
    rows = numbered(df.repartition(5), ["g"], ["o"], "nr", "t", "numbered").collect()
    for g in range(3):
        mine = sorted((r.nr, -1 if r.o is None else r.o) for r in rows if r.g == g)
        assert [n for n, _ in mine] == list(range(len(mine))) and [o for _, o in mine] == sorted(o for _, o in mine)
