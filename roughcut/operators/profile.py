"""Table profiling and skew (inventory P1-P9, A4, A6).

The profile is one aggregate job over the table (row count, per-column
cardinality, mean and standard deviation of numeric columns) turned into
one row per column, not one query per column and statistic. Histograms and
Gini coefficients are a second, separate aggregate each.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roughcut.session import is_missing_path

PROFILE_TTL_SECONDS = 20 * 60  # fixed value: profiles are fresh for 20 minutes
HISTOGRAM_BINS = 20  # fixed value: bins of the skew histogram
SKEW_GINI = 0.6  # fixed value: Gini above which a group column counts as skewed


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


PROFILE_HLL_LGK = 12  # HLL registers 2^12: about 1.6 % relative error
TREE_FANIN = 1024


def _merge_moments(a: Column, b: Column) -> Column:
    """Count, mean and M2 of two disjoint sets of rows together."""
    n, d = a["n"] + b["n"], b["m"] - a["m"]
    return F.struct(n.alias("n"), (a["m"] + d * b["n"] / n).alias("m"),
                    (a["q"] + b["q"] + d * d * a["n"] * b["n"] / n).alias("q"))


def _profile_tree(df: DataFrame, fields) -> DataFrame:
    """One wide row of profile statistics, merged in two levels.

    Level 1 aggregates per ``partition id mod TREE_FANIN`` (constant inside a
    map task): row count, a mergeable HLL sketch per column and, for numeric
    columns, ``n``, mean and ``M2`` (sum of squared deviations). Level 2
    unions the sketches and folds the moments one bucket at a time with the
    pairwise rule ``M2 = M2_a + M2_b + d^2 n_a n_b / (n_a + n_b)`` (d: the
    difference of the means), which loses nothing when the mean is large. No
    task ever merges more than TREE_FANIN partial rows.
    """
    salted = df.withColumn("__b", F.pmod(F.spark_partition_id(), F.lit(TREE_FANIN)))
    l1 = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        l1.append(F.hll_sketch_agg(c.cast("string"), PROFILE_HLL_LGK).alias(f"__hll{i}"))
        if is_numeric(f.dataType):
            x = c.cast("double")
            l1 += [F.count(c).alias(f"__n{i}"), F.avg(x).alias(f"__m{i}"),
                   F.coalesce(F.var_samp(x) * (F.count(c) - 1), F.lit(0.0)).alias(f"__q{i}")]
    level1 = salted.groupBy("__b").agg(*l1)
    l2 = [F.sum("__rows").alias("__rows")]
    for i, f in enumerate(fields):
        l2.append(F.hll_sketch_estimate(F.hll_union_agg(f"__hll{i}", True)).alias(f"__card{i}"))
        if is_numeric(f.dataType):
            part = F.struct(F.col(f"__n{i}").cast("double").alias("n"), F.col(f"__m{i}").alias("m"),
                            F.col(f"__q{i}").alias("q"))
            parts = F.collect_list(F.when(F.col(f"__n{i}") > 0, part))  # at most TREE_FANIN
            l2.append(F.aggregate(parts, F.struct(*[F.lit(0.0).alias(k) for k in "nmq"]),
                                  _merge_moments).alias(f"__M{i}"))
    one = level1.agg(*l2)
    out = [F.col("__rows")]
    for i, f in enumerate(fields):
        out.append(F.col(f"__card{i}"))
        if is_numeric(f.dataType):
            n, m, q = (F.col(f"__M{i}")[k] for k in "nmq")
            out += [F.when(n > 0, m).alias(f"__mean{i}"), F.when(n > 1, F.sqrt(q / (n - 1))).alias(f"__sd{i}")]
    return one.select(*out)


def profile_table(df: DataFrame, columns: Sequence[str] | None = None,
                  exact_cardinality: bool = False) -> DataFrame:
    """One row per column with type, cardinality, mean and stddev.

    ``exact_cardinality=False`` (the default, meant for large tables) counts
    distinct values with mergeable HLL sketches and merges every statistic
    in two levels (:func:`_profile_tree`). ``True`` uses exact distinct
    counts in one aggregate - Spark expands each row once per column before
    the shuffle, so it is meant for small tables and for checks.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not exact_cardinality:
        return _explode_profile(_profile_tree(df, fields), fields)
    stats: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        stats.append(F.count_distinct(c).alias(f"__card{i}"))
        if is_numeric(f.dataType):
            stats.append(F.avg(c).cast("double").alias(f"__mean{i}"))
            stats.append(F.stddev_samp(c).cast("double").alias(f"__sd{i}"))
    return _explode_profile(df.agg(*stats), fields)


def _explode_profile(one: DataFrame, fields) -> DataFrame:
    """Turn the one wide statistics row into one row per column."""
    rows = []
    for i, f in enumerate(fields):
        num = is_numeric(f.dataType)
        rows.append(F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(num).alias("is_numeric"),
            F.col(f"__card{i}").cast("bigint").alias("cardinality"),
            (F.col(f"__mean{i}") if num else F.lit(None).cast("double")).alias("mean"),
            (F.col(f"__sd{i}") if num else F.lit(None).cast("double")).alias("stddev"),
        ))
    return (one.select(F.col("__rows").alias("row_count"), F.explode(F.array(*rows)).alias("c"))
            .select("c.ordinal", "c.column_name", "c.data_type", "c.is_numeric",
                    "row_count", "c.cardinality", "c.mean", "c.stddev"))


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """P5: equal-width histogram over [min, max] with every bin present.

    Bin ``i`` covers ``[lo + i*w, lo + (i+1)*w)``; the maximum falls into the
    last bin. Empty bins are kept with count 0 (dropping them changes the
    Gini). Bounds and bins are those of the finite values; ``non_finite`` (the
    same in every row) counts NaN and the infinities, which have no bin. The
    bounds and that count are fetched as scalars; the bin counts are a hash
    aggregate with at most ``bins`` groups.
    """
    x = F.col(column).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fx = F.when(finite, x)
    lo, hi, other = df.agg(F.min(fx), F.max(fx), F.count(x) - F.count(fx)).first()
    other = F.lit(other).cast("bigint").alias("non_finite")
    spark = df.sparkSession
    ids = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return ids.select("bin", F.lit(None).cast("double").alias("bin_lo"),
                          F.lit(None).cast("double").alias("bin_hi"), F.lit(0).cast("bigint").alias("count"), other)
    width = (hi - lo) / bins
    if width > 0:
        b = F.least(F.lit(bins - 1), F.floor((x - F.lit(lo)) / F.lit(width))).cast("int")
    else:
        b = F.lit(0)
    counts = df.filter(finite).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return (ids.join(F.broadcast(counts), "bin", "left")
            .select("bin",
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"), other))


def gini_of_counts(counts: DataFrame, count_col: str = "count") -> DataFrame:
    """Gini coefficient of a set of counts, one output row.

    ``gini = |2 * sum(i * c_(i)) / (n * sum(c)) - (n + 1) / n|`` over the
    counts sorted ascending (i = 1..n); ``gini_normalised = gini * n/(n-1)``
    reaches 1 for total concentration whatever n is.

    Scales to any number of groups: counts are first reduced to
    (value, multiplicity) pairs, and the ranks of a run of equal values are
    summed in closed form. The running sum that needs an ordering runs over
    distinct count values only - at most sqrt(2 * total rows) of them - so the
    single ordered window is bounded by the data's square root.
    """
    freq = counts.groupBy(F.col(count_col).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = freq.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    m, a, v = F.col("m").cast("double"), F.col("before").cast("double"), F.col("v").cast("double")
    tot = ranked.agg(F.sum(v * (m * a + m * (m + 1) / 2)).alias("weighted"),
                     F.sum(m).cast("bigint").alias("n"),
                     F.sum(v * m).alias("total"))
    n = F.col("n").cast("double")
    g = F.abs(2 * F.col("weighted") / (n * F.col("total")) - (n + 1) / n)
    g = F.when((F.col("n") > 0) & (F.col("total") > 0), g).otherwise(F.lit(0.0))
    return tot.select(F.col("n").alias("groups"), g.alias("gini"),
                      F.when(F.col("n") > 1, g * n / (n - 1)).alias("gini_normalised"))


def profile_skew(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P7 for several columns in one plan: frequency Gini per column.

    Rows are stacked as ``(column_name, value)`` - one copy per profiled
    column, like an exact distinct count - and counted per value with
    map-side partial aggregation; the per-value counts are reduced to
    (count, multiplicity) pairs per column, and the only ordered window runs
    per column over those pairs (at most sqrt(2 * rows) each). Output: one
    row per column with ``groups``, ``gini`` and ``gini_normalised``.
    """
    cols = list(columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
                      for c in cols])
    stacked = df.select(F.explode(pairs).alias("s")).select("s.column_name", "s.v")
    counts = stacked.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c"))
    freq = counts.groupBy("column_name", "c").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("column_name").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    ranked = freq.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    m, a, v = F.col("m").cast("double"), F.col("before").cast("double"), F.col("c").cast("double")
    tot = ranked.groupBy("column_name").agg(F.sum(v * (m * a + m * (m + 1) / 2)).alias("weighted"),
                                            F.sum(m).cast("bigint").alias("n"),
                                            F.sum(v * m).alias("total"))
    n = F.col("n").cast("double")
    g = F.abs(2 * F.col("weighted") / (n * F.col("total")) - (n + 1) / n)
    g = F.when((F.col("n") > 0) & (F.col("total") > 0), g).otherwise(F.lit(0.0))
    return tot.select("column_name", F.col("n").alias("groups"), g.alias("gini"),
                      F.when(F.col("n") > 1, g * n / (n - 1)).alias("gini_normalised"))


def histogram_gini(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Gini of the bin counts of a numeric column (all bins)."""
    return gini_of_counts(histogram(df, column, bins), "count")


def frequency_gini(df: DataFrame, group_by: str | Sequence[str]) -> DataFrame:
    """Gini of group frequencies - is a GROUP BY column skewed?"""
    g = [group_by] if isinstance(group_by, str) else list(group_by)
    return gini_of_counts(df.groupBy(*g).agg(F.count(F.lit(1)).alias("count")), "count")


def group_distribution(df: DataFrame, group_by: str | Sequence[str]) -> DataFrame:
    """A4: rows per group and share of all rows in percent (2 decimals),
    most frequent first.

    ``SUM(COUNT(*)) OVER ()`` would pull every group into one task; the
    total is a scalar subquery instead (one extra column-less count), and
    the final ordering is Spark's distributed range sort.
    """
    g = [group_by] if isinstance(group_by, str) else list(group_by)
    counts = df.groupBy(*g).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.round(F.col("count") * 100.0 / total, 2)
    return counts.select(*g, "count", share.alias("pct")).orderBy(F.desc("count"), *g)


# ------------------------------------------------------------------ snapshots
def save_profile(profile: DataFrame, path: str, profiled_at: _dt.datetime | None = None) -> str:
    """Write (or overwrite) a profile snapshot with its timestamp."""
    ts = profiled_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    (profile.withColumn("profiled_at", F.lit(ts).cast("timestamp_ntz"))
     .coalesce(1).write.mode("overwrite").parquet(path))
    return path


def load_profile(spark, path: str, now: _dt.datetime | None = None,
                 ttl_seconds: int = PROFILE_TTL_SECONDS) -> DataFrame | None:
    """The stored profile if it is fresh, else ``None``."""
    try:
        snap = spark.read.parquet(path)
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return None  # nothing stored
    now = now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    cutoff = now - _dt.timedelta(seconds=ttl_seconds)
    fresh = snap.filter(F.col("profiled_at") >= F.lit(cutoff).cast("timestamp_ntz"))
    return fresh if fresh.limit(1).count() else None


def invalidate_profile(spark, path: str) -> None:
    """Make the snapshot stale so the next :func:`cached_profile` rebuilds
    it (an empty overwrite: no file deletion outside Spark's writer)."""
    (spark.createDataFrame([], "column_name string, profiled_at timestamp_ntz")
     .write.mode("overwrite").parquet(path))


def cached_profile(df: DataFrame, path: str, now: _dt.datetime | None = None,
                   ttl_seconds: int = PROFILE_TTL_SECONDS, skew_columns: Sequence[str] = (),
                   **kw) -> DataFrame:
    """Profile from the snapshot when fresh, otherwise profile and save.

    ``skew_columns`` (typically the GROUP BY candidates) get their frequency
    Gini stored with the profile, so the planner never recomputes it.
    """
    snap = load_profile(df.sparkSession, path, now, ttl_seconds)
    if snap is not None:
        return snap
    prof = profile_table(df, **kw)
    if skew_columns:
        skew = profile_skew(df, skew_columns).select(
            "column_name", F.col("gini_normalised").alias("group_gini_normalised"))
        prof = prof.join(F.broadcast(skew), "column_name", "left")  # one row per column
    save_profile(prof, path, now)
    return df.sparkSession.read.parquet(path)
