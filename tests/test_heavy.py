"""Heavy hitters: complete and exact above the promised share; Gini intervals that hold the exact value."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from roughcut.operators import profile as prof
from roughcut.operators.heavy import _gini, _gini_interval, heavy_hitters, is_skewed, skew_bounds, undetected_share
from roughcut.plans.aggregate import _skew


@pytest.fixture(scope="module")
def columns(spark):
    """60,000 rows: a key, a column with heavy values above a long tail, an even one, one with NULLs."""
    i = F.col("id")
    return spark.range(60_000, numPartitions=7).select(
        i.alias("key"), F.when(i % 10 < 3, F.lit(-1)).when(i % 100 == 55, F.lit(-2)).otherwise(i % 9001).alias("tail"),
        (i % 40).alias("even"), F.when(i % 2 == 0, F.concat(F.lit("="), (i % 6).cast("string"))).alias("text"),
        F.lit(1).alias("one"))


def test_heavy_hitters_are_all_values_above_the_share(columns):
    share, cols = 0.009, ["key", "tail", "even", "text"]
    rows = columns.collect()
    want = {(c, None if v is None else str(v)): n for c in cols
            for v, n in Counter(r[c] for r in rows).items() if n >= share * len(rows)}
    for df in (columns, columns.repartition(23)):
        got = heavy_hitters(df, cols, share, tracked=2000)
        assert {(r.column_name, r.value): r["count"] for r in got.collect()} == want
    assert all(r.share == r["count"] / 60_000 for r in got.collect())
    with pytest.raises(ValueError, match="tracked values"):
        heavy_hitters(columns, cols, 0.0001)
    assert heavy_hitters(columns.limit(0), cols).collect() == []
    with pytest.raises(ValueError):
        heavy_hitters(columns, [])


def test_shuffle_is_bounded_by_candidates(columns):
    """The key column's 60,000 values never shuffle: the exchanges carry summaries and counts of candidates."""
    plan = heavy_hitters(columns, ["key"], 0.05, tracked=100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "SortMergeJoin" not in plan
    keyed = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(keyed) == 3  # the summaries by bucket and then together, and the candidates' counts


def test_intervals_hold_the_exact_gini(columns):
    cols = ["key", "tail", "even", "text", "one"]
    exact = {r.column_name: r.gini_normalised or 0.0 for r in prof.profile_skew(columns, cols[:3] + ["one"]).collect()}
    exact["text"] = prof.frequency_gini(columns, "text").first().gini_normalised  # with NULL as a value
    for tracked in (100, 3000):
        got = {r.column_name: r for r in skew_bounds(columns, cols, tracked).collect()}
        for c in cols:
            assert got[c].gini_low - 1e-9 <= exact[c] <= got[c].gini_high + 1e-9, (c, tracked)
    assert got["even"].gini_low == got["even"].gini_high and got["even"].groups == 40
    assert got["one"].gini_high == 0.0 and got["one"].heavy_share == 1.0
    assert got["key"].heavy == 0 and got["tail"].heavy >= 2
    assert skew_bounds(columns.limit(0), cols).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_interval_of_random_counts(seed):
    """Any counts that agree with what is known lie inside, at every bound of the undetected share."""
    rng = random.Random(seed)
    counts = sorted(int(rng.paretovariate(rng.choice([0.6, 1.0, 2.5]))) % 5000 + 1 for _ in range(rng.randint(2, 400)))
    n = sum(counts)
    exact = _gini([(1.0, float(x)) for x in counts])
    pairs = sum(abs(a - b) for a in counts for b in counts) / (2 * len(counts) * n)
    assert exact == pytest.approx(pairs * len(counts) / (len(counts) - 1), abs=1e-9)
    for most in (1.0, 2.0, counts[-1] / 3, float(counts[-1])):
        found = [x for x in counts if x > max(most, 1.0)]
        values = len(counts) * rng.uniform(0.97, 1.03)
        head, low, high = _gini_interval(n, values, found, most)
        assert head == found and low - 1e-9 <= exact <= high + 1e-9


def test_planner_settles_the_skew_rule(columns):
    assert is_skewed(columns, "even") is False and is_skewed(columns, "one") is False
    skewed = columns.select(F.when(F.col("key") % 50 == 0, F.col("key") % 400).otherwise(-1).alias("g"))
    assert is_skewed(skewed, "g") is True
    for df, c in ((columns, "even"), (skewed, "g")):
        exact = prof.frequency_gini(df, c).first().gini_normalised
        assert (_skew(df, [c], None, None, [], None, None) > prof.SKEW_GINI) == (exact > prof.SKEW_GINI)
    assert undetected_share(3000) == 7 / 4096
