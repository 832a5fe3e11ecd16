"""Priority sampling: a weighted sample of fixed size, for sums over skewed columns.

A row of weight w gets the priority ``w / u``, u uniform from the hash of its key, and the
k rows of the largest priorities stay. The largest priority left out, tau, makes the
sample unbiased: a row's inclusion probability counts as ``min(1, w / tau)``, so heavy rows
stand for themselves and light ones for many. No other scheme of k rows does much better
for sums of any subset, and the standard error of the whole sum is at most
``sum / sqrt(k - 1)`` however the weights are spread.

The k-th priority is found without sorting the table: one pass counts priorities by
32nds of an octave, the rows above the octave part that holds the k-th are in, and only the
rows of that part are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.hashing import HASH_SPACE, with_row_hash
from roughcut.functions.ranking import numbered
from roughcut.operators.aggspec import as_aggs
from roughcut.operators.sampling import q

_PARTS = 32  # of an octave of priorities


def priority_sample(df: DataFrame, k: int, weight: Column | str, key: str | Sequence[str] | None = None,
                    h: str = "h", hash_method: str = "md5") -> DataFrame:
    """Exactly ``k`` rows of ``df`` (all with a positive weight, if they are fewer), with
    ``weight``, ``priority`` and ``inclusion`` added.

    ``weight`` is a column or expression; its absolute value counts. Rows of weight 0, NULL
    or NaN are never drawn: they add nothing to a sum of the weights, and other aggregates of
    the sample speak of the other rows only. ``key`` identifies a row (or ``df`` has its hash ``h``);
    rows that share a key share their random number. The sample is the same whatever the
    partitioning; rows of equal key and weight are interchangeable. An empty table
    gives an empty sample.
    """
    if k < 1:
        raise ValueError("a sample of one row at least")
    had = h in df.columns
    w = F.abs((F.col(weight) if isinstance(weight, str) else weight).cast("double"))
    u = (F.col(h).cast("double") + 0.5) / float(HASH_SPACE)
    rows = with_row_hash(df, key, h, hash_method).withColumn("weight", F.least(w, F.lit(1e300))) \
        .where("weight > 0 AND NOT isnan(weight)").withColumn("priority", F.col("weight") / u)
    part = F.floor(F.log2("priority") * _PARTS)
    counts = sorted(((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()),
                    reverse=True)  # a row per part of an octave that occurs
    above, cut = 0, None
    for p, n in counts:
        if above + n > k:
            cut = p
            break
        above += n
    if cut is None:
        out = rows.withColumn("inclusion", F.lit(1.0))
        return out if had else out.drop(h)
    # the order within the part that holds the k-th; the first one left out gives tau
    edge = rows.where(part == cut).withColumn("__down", -F.col("priority"))
    ranked = numbered(edge, [], ["__down", h], "__rank", "priority", "edge").drop("__down")
    tau = ranked.where(F.col("__rank") == k - above).select("priority").first()[0]
    kept = rows.where(part > cut).unionByName(ranked.where(F.col("__rank") < k - above).drop("__rank"))
    out = kept.withColumn("inclusion", F.least(F.lit(1.0), F.col("weight") / F.lit(tau)))
    return out if had else out.drop(h)


def priority_aggregate(sample: DataFrame, aggs, group_by: Sequence[str] = (), where: Column | str | None = None,
                       confidence: float = 0.95) -> DataFrame:
    """COUNT, SUM and AVG from a priority sample (a frame with ``inclusion``).

    Horvitz-Thompson with unequal probabilities p: a total is ``sum(y / p)`` with variance
    ``sum(y^2 (1 - p) / p^2)``, an average is the ratio of two totals with the variance of
    its residuals. Per aggregate ``x``: ``x``, ``x_ci_low``, ``x_ci_high``, ``x_error_pct``
    (NULL for an average of nothing); then ``sample_rows``. Groups without a sampled row
    are missing.
    """
    aggs, g = as_aggs(aggs), list(group_by)
    if any(a.func not in ("count", "sum", "avg") for a in aggs):
        raise ValueError("priority samples answer count, sum and avg")
    rows = sample if where is None else sample.where(where)
    stats = ["count(1) AS sample_rows"]
    for i, a in enumerate(aggs):
        y = "1.0D" if a.func == "count" else f"CAST({q(a.column)} AS DOUBLE)"
        there = "true" if a.column == "*" else f"{q(a.column)} IS NOT NULL"
        v = "(1.0D - inclusion) / (inclusion * inclusion)"
        for name, e in (("t", f"{y} / inclusion"), ("n", "1.0D / inclusion"), ("yy", f"{y} * {y} * {v}"),
                        ("y1", f"{y} * {v}"), ("v", v)):
            stats.append(f"coalesce(sum(CASE WHEN {there} THEN {e} END), 0.0D) AS __{name}{i}")
    stats = [F.expr(s) for s in stats]
    total = rows.groupBy(*g).agg(*stats) if g else rows.agg(*stats)
    z, out = bounds.z_value(confidence), [q(c) for c in g]
    for i, a in enumerate(aggs):
        if a.func == "avg":
            est = f"try_divide(__t{i}, __n{i})"
            var = f"greatest(__yy{i} - 2 * {est} * __y1{i} + {est} * {est} * __v{i}, 0.0D)"
            margin = f"{z}D * try_divide(sqrt({var}), __n{i})"
        else:
            est, margin = f"__t{i}", f"{z}D * sqrt(__yy{i})"
        out += [f"{est} AS {q(a.name)}", f"{est} - {margin} AS {q(a.name + '_ci_low')}",
                f"{est} + {margin} AS {q(a.name + '_ci_high')}",
                f"round(try_divide({margin}, abs({est})) * 100, 4) AS {q(a.name + '_error_pct')}"]
    return total.selectExpr(*out, "sample_rows")


def sum_bound_pct(k: int, confidence: float = 0.95) -> float:
    """Margin in percent that the sum of the weights keeps for any weights: z / sqrt(k - 1)."""
    return 100 * bounds.z_value(confidence) / (k - 1) ** 0.5 if k > 1 else float("inf")
