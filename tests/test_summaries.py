"""Range filters answered from summaries of files."""

import pytest
from pyspark.sql import functions as F

from roughcut.operators.summaries import file_summaries, range_aggregate

AGGS = [("count", "*", "c"), ("sum", "v", "s"), ("avg", "v", "a")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """100 rows a file in order, with NULL groups and values; and the same rows dealt by hash.
    The folder's name has characters that paths encode."""
    root = tmp_path_factory.mktemp("a b%c")
    i = F.col("id")
    df = spark.range(4000).select("id", F.when(i % 7 == 0, None).otherwise((i % 3).cast("string")).alias("g"),
                                  F.when(i % 11 == 0, None).otherwise((i % 100).cast("double")).alias("v"))
    df.repartitionByRange(40, "id").write.parquet(str(root / "ordered"))
    df.repartition(40, F.xxhash64("id")).write.parquet(str(root / "dealt"))
    return df, {n: (str(root / n), file_summaries(spark, str(root / n), ["id"], ["v"], ["g"]).cache()) for n in ("ordered", "dealt")}


def truth(df, low, high, *g):
    rows = df if low is None else df.where(F.col("id") >= low)
    rows = rows if high is None else rows.where(F.col("id") <= high)
    got = rows.groupBy(*g).agg(F.count("*").alias("c"), F.sum("v").alias("s"), F.avg("v").alias("a"))
    return {tuple(r[x] for x in g): (r.c, r.s, r.a) for r in got.collect()}


@pytest.mark.parametrize("low,high", [(333, 2777), (None, 1500), (3900, None), (5000, 6000), (10, 12), (None, None)])
def test_ordered_files_are_exact_and_few_are_read(spark, tables, low, high):
    df, t = tables
    path, sums = t["ordered"]
    rows = range_aggregate(spark, path, sums, "id", low, high, AGGS, ["g"]).collect()
    assert {(r.g,): (r.c, r.s, pytest.approx(r.a)) for r in rows} == truth(df, low, high, "g")
    assert all(r.files_read <= 2 and r.c_error_pct == 0 and r.s_ci_low == r.s_ci_high == r.s for r in rows)
    assert all((r.s_error_pct == 0) == (r.s is not None) for r in rows)  # a group of NULLs has no sum


def test_dealt_files_are_drawn_and_cover(spark, tables):
    df, t = tables
    path, sums = t["dealt"]
    (c, s, a), = truth(df, 500, 3300).values()
    hits = 0
    r = range_aggregate(spark, path, sums, "id", 500, 3300, AGGS, max_files=40).first()
    assert (r.c, r.s, r.files_read) == (c, s, 40) and r.a == pytest.approx(a) and r.c_error_pct == 0
    for n in range(8, 36, 8):
        r = range_aggregate(spark, path, sums, "id", 500, 3300, AGGS, max_files=n).first()
        assert r.files_read == n and r.files_straddling == 40 and 0 < r.s_error_pct < 20
        hits += (r.c_ci_low <= c <= r.c_ci_high) + (r.s_ci_low <= s <= r.s_ci_high) + (r.a_ci_low <= a <= r.a_ci_high)
    assert hits >= 9  # of 12
    one = range_aggregate(spark, path, sums, "id", 500, 3300, AGGS, max_files=1).first()
    assert one.c > 0 and one.c_error_pct is None


def test_null_range_values_and_empty_tables(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([(1, 2.0), (None, 5.0), (3, None)], "id long, v double").coalesce(1).write.parquet(p)
    sums = file_summaries(spark, p, ["id"], ["v"])
    r = range_aggregate(spark, p, sums, "id", 0, 9, AGGS).first()
    assert (r.c, r.s, r.a, r.files_inside, r.files_read) == (2, 2.0, 2.0, 0, 1)
    e = str(tmp_path / "e")
    spark.range(0).select("id", F.lit(1.0).alias("v")).write.parquet(e)
    r = range_aggregate(spark, e, file_summaries(spark, e, ["id"], ["v"]), "id", 0, 9, AGGS).first()
    assert (r.c, r.s, r.a, r.files_read) == (0, None, None, 0)
    with pytest.raises(ValueError):
        range_aggregate(spark, p, sums, "id", 0, 9, [("max", "v")])


def test_files_outside_are_not_opened(spark, tables):
    _, t = tables
    path, sums = t["ordered"]
    plan = range_aggregate(spark, path, sums, "id", 333, 2777, AGGS)
    assert sum("part-" in f for f in plan.inputFiles()) <= 2
