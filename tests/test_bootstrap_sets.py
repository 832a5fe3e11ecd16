"""Poisson bootstrap intervals, and distinct counts of combined conditions."""

import pytest
from pyspark.sql import functions as F

from roughcut.operators.bootstrap import Ratio, bootstrap_aggregate, poisson_thresholds
from roughcut.operators.distinct_sets import distinct_in, is_in, merge_value_sketches, value_sketches
from roughcut.operators.sampling import uniform_sample


def test_poisson_weights_have_mean_and_variance_one():
    t = [0, *poisson_thresholds(), 1 << 15]
    p = [(b - a) / (1 << 15) for a, b in zip(t, t[1:])]
    mean = sum(k * x for k, x in enumerate(p))
    assert abs(mean - 1) < 1e-3 and abs(sum(k * k * x for k, x in enumerate(p)) - mean ** 2 - 1) < 5e-3


def test_intervals_cover(spark):
    """Over 12 salts, three statistics in two groups: nominal 95 % intervals hold the truth."""
    i = F.col("id")
    df = spark.range(40_000).select("id", (i % 2).alias("g"), F.exp((i * 7919 % 1000) / 250).alias("y"),
                                    (1 + i * 31 % 17).cast("double").alias("x")).repartition(8).cache()
    exact = {r.g: r for r in df.groupBy("g").agg(F.sum("y").alias("s"), (F.sum("y") / F.sum("x")).alias("r"),
                                                 F.expr("percentile(y, 0.5)").alias("m")).collect()}
    hits = {"s": 0, "r": 0, "m": 0}
    salted = df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(11))))
    s = uniform_sample(salted, 0.05, ["salt", "id"], hash_method="xxhash")
    rows = bootstrap_aggregate(s, [("sum", "y", "s"), Ratio("r", "y", "x"), ("median", "y", "m")], 0.05, ["salt", "g"],
                               hash_method="xxhash").collect()
    assert len(rows) == 24
    for r in rows:
        for k in hits:
            hits[k] += r[f"{k}_ci_low"] <= exact[r.g][k] <= r[f"{k}_ci_high"]
    assert all(n >= 20 for n in hits.values()), hits  # of 24


def test_repeatable_and_whole_samples_have_no_width(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("y"))
    aggs = ["count(*)", ("avg", "y", "a"), ("median", "y", "m")]
    s = uniform_sample(df, 0.2, "id")
    a, b = (bootstrap_aggregate(x, aggs, 0.2).first() for x in (s, s.repartition(5)))
    assert a.sample_rows == b.sample_rows and a.count_rows_ci_low == pytest.approx(b.count_rows_ci_low) \
        and a.a_ci_high == pytest.approx(b.a_ci_high)
    whole = bootstrap_aggregate(df, aggs, 1.0, key="id").first()
    assert whole.count_rows == whole.count_rows_ci_low == whole.count_rows_ci_high == 3000
    assert whole.a == whole.a_ci_low == whole.a_ci_high and whole.m == 3.0


def test_nulls_small_groups_and_nothing(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", None), (3, None, None), (4, None, 7.0)], "id long, g string, y double")
    r = {x.g: x for x in bootstrap_aggregate(df, [("sum", "y", "s"), ("avg", "y", "v"), Ratio("r", "y", "id"), ("median", "y", "m")],
                                             0.5, ["g"], key="id").collect()}
    assert (r["a"].s, r["a"].v, r["a"].r, r["a"].m) == (10.0, 5.0, 5.0, 5.0) and r["a"].v_ci_low is None
    assert r[None].s == 14.0 and r[None].sample_rows == 2
    empty = bootstrap_aggregate(df.limit(0), ["count(*)", ("avg", "y", "v"), ("median", "y", "m")], 0.5, key="id").first()
    assert empty.sample_rows == 0 and empty.count_rows == 0 and empty.v is None and empty.m is None
    assert bootstrap_aggregate(df.limit(0), ["count(*)"], 0.5, ["g"], key="id").collect() == []
    with pytest.raises(ValueError):
        bootstrap_aggregate(df, ["count(*)"], 0.5, key="id", replicates=10)
    with pytest.raises(ValueError):
        bootstrap_aggregate(df, [("max", "y")], 0.5, key="id")


@pytest.fixture(scope="module")
def visits(spark):
    i = F.col("id")
    return spark.range(60_000).select((i * 7919 % 20_011).alias("user"), F.when(i % 11 == 0, None).otherwise(
        F.element_at(F.array(*map(F.lit, "abc")), (1 + i % 3).cast("int"))).alias("kind"), (i % 5 == 0).alias("paid"))


def test_sets_hold_the_exact_counts(spark, visits):
    a, b, none, paid = is_in("kind", "a"), is_in("kind", "b"), is_in("kind", None), is_in("paid", True)
    sets = {"and": a & b, "or": a | b, "not": a - b, "three": (a & paid) - none, "null": none, "never": is_in("kind", "z"),
            "all": a | b | is_in("kind", "c") | none}
    got = {r.set_name: r for r in distinct_in(value_sketches(visits, "user", ["kind", "paid"], 10), sets, 0.9999).collect()}
    per = visits.groupBy("user").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in (
        ("a", F.col("kind") == "a"), ("b", F.col("kind") == "b"), ("n", F.col("kind").isNull()), ("p", F.col("paid")))])
    for name, cond in (("and", "a AND b"), ("or", "a OR b"), ("not", "a AND NOT b"), ("three", "a AND p AND NOT n"),
                       ("null", "n"), ("all", "true")):
        n = per.where(cond).count()
        assert got[name].ci_low <= n <= got[name].ci_high, (name, n, got[name])
    assert got["never"].distinct_keys == got["never"].ci_high == 0


def test_small_sets_are_exact_and_sketches_merge(spark, visits):
    few = visits.where("user < 900")
    a, b = is_in("kind", "a"), is_in("kind", "b")
    halves = [value_sketches(few.where(c), "user", ["kind"]) for c in ("user % 2 = 0 OR kind = 'a'", "user % 2 = 1")]
    r = {x.set_name: x for x in distinct_in(merge_value_sketches(halves[0].unionByName(halves[1])), {"x": a & b, "y": a}).collect()}
    loose = distinct_in(halves[0].unionByName(halves[1]), {"x": a & b}).first()
    assert loose.distinct_keys == r["x"].distinct_keys  # unmerged sketches are united too
    users = {k: {x.user for x in few.where(F.col("kind") == k).collect()} for k in "ab"}
    assert r["x"].distinct_keys == r["x"].ci_low == r["x"].ci_high == len(users["a"] & users["b"])
    assert r["y"].distinct_keys == len(users["a"])


def test_sets_of_nothing(spark, visits):
    sk = value_sketches(visits.limit(0), "user", ["kind"])
    r = distinct_in(sk, {"x": is_in("kind", "a") - is_in("kind", "b")}).first()
    assert (r.distinct_keys, r.ci_low, r.ci_high) == (0, 0.0, 0.0)
    assert value_sketches(visits.withColumn("user", F.lit(None).cast("long")), "user", ["kind"]).count() == 0
    with pytest.raises(ValueError):
        value_sketches(visits, "user", ["kind"], 40)


def test_only_the_sketches_asked_for_are_read(spark, visits, tmp_path):
    value_sketches(visits, "user", ["kind"], 8).write.parquet(str(tmp_path / "sk"))
    plan = distinct_in(spark.read.parquet(str(tmp_path / "sk")), {"x": is_in("kind", "a")})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(attribute,kind)" in plan
