"""Distinct-count and quantile sketches (inventory F1-F6, Q1-Q6).

All sketches are Spark built-in aggregates. They aggregate partially on each
executor and merge in the final aggregate, so the shuffle carries one small
sketch per group and partition instead of rows; an exact COUNT(DISTINCT)
shuffles every distinct value and an exact percentile holds every value of a
group in one task. Sketch columns (``BinaryType``) can be stored and merged
later: sketch per day / region / file, union at query time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RSD = 0.04  # nominal relative error of the engine's distinct counter
DEFAULT_HLL_P = 14
DEFAULT_KLL_K = 200
DEFAULT_PCT_ACCURACY = 1_000  # rank error at most 1 / accuracy of the rows (99 % confidence)
MAX_KLL_K = 65_535
TREE_FANIN = 1024  # partial sketches merged by one task, at most


def _agg(df: DataFrame, group_by: Sequence[str], *cols: Column) -> DataFrame:
    return df.groupBy(*group_by).agg(*cols) if group_by else df.agg(*cols)


def _tree(df: DataFrame, group_by: Sequence[str], sketch: Column, merge) -> DataFrame:
    """Two-level aggregation of a mergeable sketch.

    One partial sketch per map task would all meet in a single task for an
    ungrouped (or hot) group: at 800k input splits that is 800k sketches in
    one reducer. Level 1 groups by ``(group, partition id mod TREE_FANIN)``
    - constant within a map task, so map-side partial aggregation still
    leaves one sketch per task - and merges them across up to TREE_FANIN
    reducers per group; level 2 unions at most TREE_FANIN sketches per
    group. The salt is the partition id, so a retried task lands in the
    same bucket.
    """
    return tree_aggregate(df, group_by, {"__sk": (sketch, merge)})


def tree_aggregate(df: DataFrame, group_by: Sequence[str],
                   parts: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Several two-level aggregates (see :func:`_tree`) in one pass over ``df``.

    ``parts`` maps an output name to the aggregate of a bucket and the function
    that merges the buckets' results.
    """
    g = list(group_by)
    salted = df.withColumn("__bucket", F.pmod(F.spark_partition_id(), F.lit(TREE_FANIN)))
    level1 = salted.groupBy(*g, "__bucket").agg(*[c.alias(n) for n, (c, _) in parts.items()])
    return _agg(level1, g, *[merge(F.col(n)).alias(n) for n, (_, merge) in parts.items()])


def hll_merged(c: Column) -> Column:
    return F.hll_union_agg(c, True)


def quantile_name(p: float) -> str:
    """Column name for a percentile: 0.5 -> median, 0.95 -> p95, 0.999 -> p99_9.

    Built from the decimal text of ``p`` so 0.29 is ``p29`` (not ``p28``)
    and 0.999 does not collide with 0.99.
    """
    if p == 0.5:
        return "median"
    txt = format((Decimal(repr(p)) * 100).normalize(), "f")
    return "p" + txt.replace(".", "_")


# ------------------------------------------------------------------ distinct
def approx_distinct(df: DataFrame, column: str, group_by: Sequence[str] = (),
                    rsd: float = DEFAULT_RSD, alias: str = "approx_distinct") -> DataFrame:
    """Distinct count within a relative standard deviation ``rsd`` (any filter is
    applied to ``df``): an HLL sketch of the smallest precision that promises it."""
    return hll_distinct(df, column, precision_for(rsd), group_by, alias)


def precision_for(rsd: float) -> int:
    """Smallest HLL precision whose error ``1.04 / 2^(p/2)`` is at most ``rsd``."""
    return min(21, max(4, math.ceil(2 * math.log2(1.04 / rsd))))


def hll_sketch(column: str, precision: int = DEFAULT_HLL_P) -> Column:
    """mergeable HLL sketch column with ``2^precision`` registers."""
    return F.hll_sketch_agg(F.col(column), precision)


def hll_distinct(df: DataFrame, column: str, precision: int = DEFAULT_HLL_P,
                 group_by: Sequence[str] = (), alias: str = "approx_distinct",
                 tree: bool = True) -> DataFrame:
    """distinct count at a chosen precision; NULLs are skipped.

    ``tree=True`` merges the partial sketches in two levels (see
    :func:`_tree`), bounding what any single task merges.
    """
    g = list(group_by)
    if not tree:
        return _agg(df, g, F.hll_sketch_estimate(hll_sketch(column, precision)).alias(alias))
    merged = _tree(df, g, hll_sketch(column, precision), hll_merged)
    return merged.select(*g, F.hll_sketch_estimate("__sk").alias(alias))


def hll_error_pct(precision: int) -> float:
    """nominal relative standard error 1.04 / 2^(p/2), in percent."""
    return 104.0 / (2 ** (precision / 2))


def hll_sketches(df: DataFrame, column: str, group_by: Sequence[str],
                 precision: int = DEFAULT_HLL_P, alias: str = "sketch") -> DataFrame:
    """one sketch per group (storable), merged in two levels: a hot group's partial
    sketches do not meet in one task."""
    res = _tree(df, group_by, hll_sketch(column, precision), hll_merged)
    return res.withColumnRenamed("__sk", alias)


def hll_sweep(df: DataFrame, column: str, precisions: Sequence[int]) -> DataFrame:
    """estimates ``e<p>`` at several precisions, from one pass."""
    res = tree_aggregate(df, [], {f"e{p}": (hll_sketch(column, p), hll_merged) for p in precisions})
    return res.select(*[F.hll_sketch_estimate(f"e{p}").alias(f"e{p}") for p in precisions])


def merge_hll(sketches: DataFrame, group_by: Sequence[str] = (), sketch: str = "sketch",
              alias: str = "approx_distinct") -> DataFrame:
    """union sketches (per remaining group) and estimate."""
    est = F.hll_sketch_estimate(F.hll_union_agg(F.col(sketch), True))
    return _agg(sketches, list(group_by), est.alias(alias))


# ------------------------------------------------------------------ quantiles
def approx_quantiles(df: DataFrame, column: str, probs: Sequence[float] = (0.5,),
                     group_by: Sequence[str] = (), accuracy: int = DEFAULT_PCT_ACCURACY
                     ) -> DataFrame:
    """Q1/Q2/Q6: quantiles with a rank error of at most ``1/accuracy`` of the row count
    (99 % confidence), all probabilities in one pass.

    Output columns are named by :func:`quantile_name` and typed double. The
    summary is a KLL sketch of the size that the accuracy needs, because its
    partials merge in two levels (those of ``percentile_approx`` cannot be
    merged in SQL and all meet in one task per group).
    """
    return kll_quantiles(df, column, probs, group_by, k_for(accuracy))


def k_for(accuracy: float) -> int:
    """KLL size whose rank error ``2.446 / k^0.9433`` is at most ``1 / accuracy``."""
    return min(MAX_KLL_K, max(8, math.ceil((2.446 * accuracy) ** (1 / 0.9433))))


def kll_sketch(column: str, k: int = DEFAULT_KLL_K) -> Column:
    """Q3: mergeable KLL quantile sketch (rank error about 1.65 % at k=200)."""
    return F.kll_sketch_agg_double(F.col(column).cast("double"), k)


def kll_quantiles(df: DataFrame, column: str, probs: Sequence[float] = (0.5,),
                  group_by: Sequence[str] = (), k: int = DEFAULT_KLL_K,
                  tree: bool = True) -> DataFrame:
    """Q3: quantiles from a KLL sketch with a tunable ``k`` (rank error about
    1.65 % at k=200, falling roughly as 1/k); ``tree=True`` merges the
    partial sketches in two levels (see :func:`_tree`)."""
    g = list(group_by)
    if tree:
        res = _tree(df, g, kll_sketch(column, k), F.kll_merge_agg_double)
    else:
        res = _agg(df, g, kll_sketch(column, k).alias("__sk"))
    return res.select(*g, *[
        F.kll_sketch_get_quantile_double(F.col("__sk"), F.lit(float(p))).alias(quantile_name(p))
        for p in probs])


def kll_sketches(df: DataFrame, column: str, group_by: Sequence[str],
                 k: int = DEFAULT_KLL_K, alias: str = "sketch") -> DataFrame:
    """Q5: one KLL sketch per group (storable), merged in two levels."""
    return _tree(df, group_by, kll_sketch(column, k), F.kll_merge_agg_double).withColumnRenamed("__sk", alias)


def merge_kll(sketches: DataFrame, probs: Sequence[float] = (0.5,),
              group_by: Sequence[str] = (), sketch: str = "sketch") -> DataFrame:
    """Q5: merge KLL sketches and read quantiles."""
    res = _agg(sketches, list(group_by), F.kll_merge_agg_double(F.col(sketch)).alias("__s"))
    return res.select(*group_by, *[
        F.kll_sketch_get_quantile_double(F.col("__s"), F.lit(float(p))).alias(quantile_name(p))
        for p in probs])


def kll_error_estimate(k: int) -> float:
    """Error figure reported with a KLL answer: ``1/k`` (4 decimals), the
    same convention as the reference's ``1/compression``."""
    return round(1.0 / k, 4)
