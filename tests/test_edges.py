"""Edge cases: NULLs, empty inputs, filters that match nothing."""

from pyspark.sql import functions as F

from roughcut.operators import sampling, stratified
from roughcut.operators.quantile import exact_quantile, exact_quantile_grouped
from roughcut.operators.samples import SampleStore
from roughcut.plans.aggregate import approx_aggregate
from roughcut.session import shared_dir


def _with_nulls(sales):
    return sales.withColumn("amount", F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("amount")))


def test_count_column_skips_nulls_count_star_does_not(sales):
    s = _with_nulls(sales)
    r = sampling.sample_aggregate(s, ["count(*)", "count(amount)", "avg(amount)"], 1.0).first()
    assert r["count_rows"] == 10_000 and r["count_amount"] == 7_500
    want = s.agg(F.avg("amount")).first()[0]
    assert abs(r["avg_amount"] - float(want)) < 1e-9


def test_stratified_count_column_with_nulls(sales):
    s = _with_nulls(sales)
    rows = {r["region"]: r for r in
            stratified.stratified_aggregate(s, "region", ["count(amount)"], 1.0).collect()}
    assert sum(r["count_amount"] for r in rows.values()) == 7_500


def test_tier_filter_matching_nothing(spark, sales):
    st = SampleStore(spark, shared_dir(spark, "test", "edges-tier"))
    st.build_tiers(sales, "sales", "event_id")
    r = st.tier_aggregate("sales", ["count(*)", "sum(amount)"], rate=0.1,
                          where=F.col("amount") < 0).first()
    assert r["count_rows"] == 0 and r["count_rows_error_pct"] is None
    assert r["sum_amount"] is None


def test_stored_stratified_with_filter(spark, sales):
    st = SampleStore(spark, shared_dir(spark, "test", "edges-strat"))
    st.build_stratified(sales, "sales", "region", "event_id", 0.1)
    got = {r["region"]: r["count_rows"] for r in
           st.stratified_aggregate("sales", "region", ["count(*)"], where=F.col("amount") > 50).collect()}
    rows = stratified.stratified_aggregate(sales, "region", ["count(*)"], 0.1,
                                           where=F.col("amount") > 50).collect()
    assert got == {r["region"]: r["count_rows"] for r in rows}


def test_empty_input(spark, sales):
    empty = sales.filter(F.col("event_id") < 0)
    res, plan = approx_aggregate(empty, ["count(*)", "avg(amount)"], return_plan=True)
    r = res.first()
    assert plan.strategy == "exact" and r["count_rows"] == 0 and r["avg_amount"] is None
    assert approx_aggregate(empty, ["count(*)"], ["region"]).count() == 0
    assert exact_quantile(empty, "amount", 0.5, alias="q").first()["q"] is None
    assert exact_quantile_grouped(empty, "region", "amount", 0.5, alias="q").count() == 0
    assert stratified.stratified_sample(empty, "region", 0.1).count() == 0


def test_null_values_in_quantiles(sales):
    s = _with_nulls(sales)
    got = exact_quantile(s, "amount", 0.5, alias="q", small=100, k=50).first()["q"]
    want = s.agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(amount AS DOUBLE))")).first()[0]
    assert abs(got - want) < 1e-9


def test_stored_stratified_keeps_null_stratum(spark, sales):
    s = sales.withColumn("region", F.when(F.col("event_id") % 500 == 7, None).otherwise(F.col("region")))
    st = SampleStore(spark, shared_dir(spark, "test", "edges-null"))
    st.build_stratified(s.drop("h"), "sales", "region", "event_id", 0.1)
    got = {r["region"]: r["count_rows"] for r in st.stratified_aggregate("sales", "region", ["count(*)"]).collect()}
    assert None in got and sum(got.values()) == 10_000


def test_refresh_keeps_hash_method(spark, sales):
    st = SampleStore(spark, shared_dir(spark, "test", "edges-xx"))
    base = sales.drop("h")
    st.build_tiers(base, "sales", "event_id", hash_method="xxhash")
    before = {r["sample_type"]: r["sample_rows"] for r in st.registry().collect()}
    st.refresh("sales", base)
    after = {r["sample_type"]: (r["sample_rows"], r["hash_method"]) for r in st.registry().collect()}
    assert {k: v[0] for k, v in after.items()} == before
    assert {v[1] for v in after.values()} == {"xxhash"}


def test_grouped_parts_join_null_safely(sales):
    """A NULL group appears once when per-group parts are combined."""
    from roughcut.plans.aggregate import exact_aggregate
    s = sales.withColumn("region", F.when(F.col("event_id") % 500 == 7, None).otherwise(F.col("region")))
    rows = exact_aggregate(s, [("count", "*", "cnt"), ("median", "amount", "med")], ["region"]).collect()
    assert len(rows) == 4 and sum(1 for r in rows if r["region"] is None) == 1
    want = {r[0]: r[1] for r in s.groupBy("region").agg(
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY CAST(amount AS DOUBLE))")).collect()}
    assert all(abs(r["med"] - want[r["region"]]) < 1e-9 for r in rows)  # NULL group included
    r = approx_aggregate(s, [("count", "*", "cnt"), ("count_distinct", "user_id", "u")], ["region"]).collect()
    assert len(r) == 4


def test_failed_rebuild_keeps_previous_version(spark, sales):
    """A build that dies mid-write publishes nothing: readers keep the
    previous version (an in-place overwrite would have deleted it)."""
    st = SampleStore(spark, shared_dir(spark, "test", "edges-version"))
    st.build_tiers(sales, "sales", "event_id")
    before = st.tier("sales", 0.1).count()
    broken = sales.withColumn("amount", F.expr("raise_error('executor lost')"))
    try:
        st.build_tiers(broken, "sales", "event_id")
    except Exception:
        pass
    assert st.tier("sales", 0.1).count() == before
    assert st.registry().count() == 3


def test_refresh_vacuums_old_versions(spark, sales):
    st = SampleStore(spark, shared_dir(spark, "test", "edges-vacuum"))
    st.build_tiers(sales, "sales", "event_id")
    first = {r["data_path"] for r in st.registry().collect()}
    planned = st.tier("sales", 0.1)  # a reader that planned before the refresh
    one = st.refresh("sales", sales).collect()
    second = {r["data_path"] for r in st.registry().collect()}
    assert first.isdisjoint(second) and len(second) == 1
    assert [r["action"] for r in one] == ["created"] and planned.count() > 0  # the replaced build stays
    two = {r["action"]: r["path"] for r in st.refresh("sales", sales).collect()}
    now = {r["data_path"] for r in st.registry().collect()}
    assert two["dropped"] + "/data" in first and two["created"] + "/data" in now
    assert {r["data_path"] for r in st._all_meta().collect()} == now | second  # older metadata gone
    assert st.tier("sales", 0.01).count() > 0


def test_tier_subsample_below_stored_rates(spark, sales):
    from roughcut.functions.hashing import threshold
    st = SampleStore(spark, shared_dir(spark, "test", "edges-sub"))
    st.build_tiers(sales, "sales", "event_id")
    assert st.tier("sales", 0.05).count() == sales.filter(F.col("h") < threshold(0.05)).count()


def test_vacuum_removes_abandoned_builds(spark, sales):
    """A driver that dies mid-build leaves an unpublished version folder
    (a failed *job* is cleaned by Spark's committer, so the folder is made
    here directly); vacuum removes it once old enough."""
    st = SampleStore(spark, shared_dir(spark, "test", "edges-abandoned"))
    st.build_tiers(sales, "sales", "event_id")
    sales.limit(10).write.parquet(f"{st.root}/sales/tiers/v00000000000000000001-dead/data")
    assert st.vacuum(abandoned_after_hours=24) == []  # too young to call abandoned
    gone = st.vacuum(abandoned_after_hours=0)
    assert gone == [f"{st.root}/sales/tiers/v00000000000000000001-dead"]
    assert st.tier("sales", 0.1).count() > 0  # the published build is untouched


def test_grouped_selection_null_group_forced_rounds(sales):
    s = sales.withColumn("region", F.when(F.col("event_id") % 50 == 7, None).otherwise(F.col("region")))
    got = {r["region"]: r["q"] for r in
           exact_quantile_grouped(s, "region", "amount", 0.3, alias="q", small=20, k=20).collect()}
    want = {r[0]: r[1] for r in s.groupBy("region").agg(
        F.expr("percentile_cont(0.3) WITHIN GROUP (ORDER BY CAST(amount AS DOUBLE))")).collect()}
    assert got.keys() == want.keys() and None in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_composite_key_null_parts_differ(spark):
    from roughcut.functions.hashing import hash60
    df = spark.createDataFrame([(1, None, 2), (1, 2, None)], "a int, b int, c int")
    for method in ("md5", "xxhash"):
        hs = [r[0] for r in df.select(hash60(["a", "b", "c"], method)).collect()]
        assert hs[0] != hs[1], method
        assert all(0 <= h < 1 << 60 for h in hs)
