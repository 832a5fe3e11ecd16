"""Physical-plan shape: what scales, stays scaling."""

from pyspark.sql import functions as F

from roughcut.operators import sampling, stratified
from roughcut.functions.hashing import threshold
from roughcut.session import shared_dir
from roughcut.sources.tables import load_sales


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_derived_view_prunes_columns(spark):
    from tests.conftest import SF01
    s = load_sales(spark, SF01)
    df = sampling.sample_aggregate(s, ["count(*)"], 0.1, where=F.col("amount") > 50, key="event_id")
    assert "ReadSchema: struct<event_id:bigint,value:double>" in _plan(df)


def test_stored_table_pushes_amount_and_hash(spark, sales):
    """Written with its hash, the sample predicate reaches Parquet too."""
    path = shared_dir(spark, "test", "pushdown")
    sales.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    df = sampling.sample_aggregate(stored, ["count(*)"], 0.1, where=F.col("amount") > 50)
    p = _plan(df)
    assert "GreaterThan(amount,50.00)" in p
    assert f"LessThan(h,{threshold(0.1)})" in p
    assert "ReadSchema: struct<amount:decimal(10,2),h:bigint>" in p


def test_stratified_estimate_is_one_aggregate(sales):
    df = stratified.stratified_aggregate(sales, "region", ["count(*)", "sum(amount)"], 0.01)
    p = _plan(df)
    assert "Join" not in p
    assert p.count("Exchange") == 1


def test_stratified_sample_filters_base_rows_in_place(spark, sales):
    """Base rows are filtered, and matched against broadcast empty strata; only the rows
    that tie for an empty stratum are shuffled, reduced to one per task and stratum."""
    df = stratified.stratified_sample(sales, "region", 0.01)
    p = _plan(df)
    assert "BroadcastHashJoin" in p and "Union" in p
    assert "SortMergeJoin" not in p
    assert p.count("Exchange hashpartitioning(region") <= 1  # strata were checkpointed


def test_stratified_sample_many_strata_fallback(sales):
    """Past the broadcast bound the forced rows come out of an aggregate."""
    small = stratified.stratified_sample(sales, "region", 0.01)
    big = stratified.stratified_sample(sales, "region", 0.01, broadcast_bytes=0)
    assert "Join" not in _plan(big)
    key = lambda df: sorted(r["event_id"] for r in df.select("event_id").collect())
    assert key(small) == key(big)
