"""Spread-aware strata: one budget of rows dealt to strata by how much their values vary
(S2, S4-S6).

An equal rate gives a stratum of even values as many rows as one of the same size whose
values vary, and large strata far more than they need. With N rows, mean m and standard
deviation s per stratum:

* ``aim="total"`` (Neyman): rows in proportion to ``N * s``, the least variance of the
  total over all strata;
* ``aim="groups"``: rows in proportion to ``(s / m)^2``, which evens out the relative
  margins of the strata's own sums, so that the worst of them is least.

Each stratum has a hash threshold of its own; estimates scale by its own realised rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.hashing import HASH_SPACE, with_row_hash
from roughcut.operators.aggspec import as_aggs
from roughcut.operators.sampling import agg_sql, q
from roughcut.operators.stratified import count_interval
from roughcut.session import stored

#: Rows that a stratum gets at least (all, if it has fewer): fewer than two would leave no
#: spread to state a margin from, and with an expected 20 that all but never happens.
LEAST_ROWS = 20
_TRIES = 32  # factors tried in one pass over the strata


def allocate(df: DataFrame, group_by: str | Sequence[str], value: str, budget: int,
             aim: str = "groups", least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per stratum: the group columns, ``population_count, mean, stddev,
    target_rows`` and the hash ``threshold``; the targets sum to ``budget`` (to a thousandth).

    Targets are ``factor * x`` with x as the aim has it, at least ``least_rows`` and at most all
    rows; the factor is found by a few passes over the strata (a row each), which try
    many factors at once. A stratum without values, or of values that do not vary, gets
    ``least_rows``; one whose mean is 0 counts with the mean absolute value instead. A budget
    below the least or above all rows raises.
    """
    g = [group_by] if isinstance(group_by, str) else list(group_by)
    if aim not in ("total", "groups"):
        raise ValueError("aim at the 'total' or at the 'groups'")
    y = F.col(value).cast("double")
    strata = df.groupBy(*g).agg(F.count(F.lit(1)).alias("population_count"), F.avg(y).alias("mean"),
                                F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("stddev"), F.avg(F.abs(y)).alias("__abs"))
    level = F.when(F.col("mean") != 0, F.abs("mean")).otherwise(F.col("__abs"))
    x = (F.col("population_count") * F.col("stddev") if aim == "total"
         else F.coalesce(F.pow(F.try_divide("stddev", level), F.lit(2)), F.lit(0.0)))
    strata = stored(strata.withColumn("__x", x).drop("__abs"), "allocation", "strata")
    N = F.col("population_count").cast("double")

    def target(factor: Column) -> Column:
        return F.least(N, F.greatest(F.lit(float(least_rows)), factor * F.col("__x")))
    low, high = strata.agg(F.sum(target(F.lit(0.0))), F.sum("population_count")).first()
    if low is None:
        return strata.withColumn("target_rows", N).withColumn("threshold", F.lit(HASH_SPACE)).drop("__x")
    if not low <= budget <= high:
        raise ValueError(f"a budget between {low:.0f} rows ({least_rows} a stratum) and all {high}")
    # the sum of the targets grows with the factor: narrow it down between powers of two, then evenly
    most = strata.where("__x > 0").agg(F.max(N / F.col("__x"))).first()[0] or 1.0
    lo, hi = 0.0, float(most)
    tries = [hi / 2 ** (2 * i) for i in range(_TRIES)][::-1]
    for _ in range(6):
        sums = strata.agg(*[F.sum(target(F.lit(f))) for f in tries]).first()
        lo = max([lo, *[f for f, s in zip(tries, sums) if s <= budget]])
        hi = min([hi, *[f for f, s in zip(tries, sums) if s >= budget]])
        if hi - lo <= 1e-6 * hi:
            break
        tries = [lo + (hi - lo) * (i + 1) / (_TRIES + 1) for i in range(_TRIES)]
    n = target(F.lit(hi))
    thr = F.least(F.lit(HASH_SPACE), F.ceil(n / N * float(HASH_SPACE)).cast("long"))
    return strata.withColumn("target_rows", n).withColumn("threshold", F.when(n >= N, F.lit(HASH_SPACE)).otherwise(thr)).drop("__x")


def _same_group(g: list[str]) -> Column:
    cond = None
    for c in g:
        eq = F.col(c).eqNullSafe(F.col(f"__s_{c}"))
        cond = eq if cond is None else cond & eq
    return cond


def allocated_sample(df: DataFrame, strata: DataFrame, group_by: str | Sequence[str], key=None, h: str = "h",
                     hash_method: str = "md5") -> DataFrame:
    """The rows of ``df`` below their stratum's threshold, with ``population_count`` (a filter
    after a join with the strata; rows do not shuffle while the strata are small).

    A stratum of two rows or more that fewer than two hashes fall into (all but impossible with the
    default least rows) keeps its rows of the two least hashes as well.
    """
    g = [group_by] if isinstance(group_by, str) else list(group_by)
    hashed = with_row_hash(df, key, h, hash_method)
    side = strata.select(*[F.col(c).alias(f"__s_{c}") for c in g], "population_count", "threshold")
    rows = hashed.join(side, _same_group(g)).drop(*[f"__s_{c}" for c in g])
    kept = rows.where(F.col(h) < F.col("threshold"))
    short = stored(strata.select(*[F.col(c).alias(f"__s_{c}") for c in g], "population_count").join(
        kept.groupBy(*g).agg(F.count("*").alias("__n")), _same_group(g), "left")
        .where("coalesce(__n, 0) < least(2, population_count)").select(*[f"__s_{c}" for c in g]), "allocation", "short")
    if short.isEmpty():
        return kept.drop("threshold")
    few = rows.join(short, _same_group(g), "left_semi")
    first = few.groupBy(*[F.col(c).alias(f"__s_{c}") for c in g]).agg(F.min(h).alias("__h1"))
    second = few.join(first, _same_group(g)).where(F.col(h) > F.col("__h1")) \
        .groupBy(*[f"__s_{c}" for c in g]).agg(F.min(h).alias("__h2"))
    least = first.select(*[f"__s_{c}" for c in g], F.col("__h1").alias("__h")).unionByName(
        second.select(*[f"__s_{c}" for c in g], F.col("__h2").alias("__h")))
    forced = few.join(least, _same_group(g) & (F.col(h) == F.col("__h")) & (F.col(h) >= F.col("threshold")))
    return kept.unionByName(forced.select(*kept.columns)).drop("threshold")


def allocated_aggregate(sample: DataFrame, group_by: str | Sequence[str], aggs,
                        where: Column | str | None = None) -> DataFrame:
    """Estimates per stratum from an allocated sample, each scaled by the stratum's own realised
    rate ``n_g / N_g``: the group columns, per COUNT and SUM ``x, x_ci_low, x_ci_high, x_error_pct``
    and per AVG ``x`` with the same, ``sample_count``, ``population_count``. Under a filter every
    sampled stratum stays, and the margin of a SUM counts that the number of matches is unknown
    (see :func:`roughcut.functions.bounds.domain_sum_sql`)."""
    g = [group_by] if isinstance(group_by, str) else list(group_by)
    aggs = as_aggs(aggs)
    if any(a.func not in ("count", "sum", "avg") for a in aggs):
        raise ValueError("allocated strata answer count, sum and avg")
    rows = sample.withColumn("__w", F.lit(True) if where is None else F.coalesce(
        F.expr(where) if isinstance(where, str) else where, F.lit(False)))
    stats = ["count(1) AS sample_count", "max(population_count) AS population_count"]
    for a in aggs:
        match = "FILTER (WHERE __w)"
        stats.append(f"{agg_sql(a) if a.func != 'avg' else f'sum({q(a.column)})'} {match} AS {q(a.name + '__s')}")
        if a.func != "count":
            stats += [f"stddev_samp({q(a.column)}) {match} AS {q(a.name + '__sd')}", f"count({q(a.column)}) {match} AS {q(a.name + '__k')}",
                      f"CAST(min({q(a.column)}) AS DOUBLE) AS {q(a.name + '__lo')}", f"CAST(max({q(a.column)}) AS DOUBLE) AS {q(a.name + '__hi')}"]
    agg = rows.groupBy(*g).agg(*[F.expr(s) for s in stats])
    n, N, out = "sample_count", "population_count", [q(c) for c in g]
    for a in aggs:
        v, sd, k = q(a.name + "__s"), q(a.name + "__sd"), q(a.name + "__k")
        if a.func == "count":
            out += [f"CAST(floor({v} * {N} / {n}) AS BIGINT) AS {q(a.name)}", *count_interval(a, v, n, N, where is not None)]
        elif a.func == "sum":
            d = f"coalesce(CAST({v} AS DOUBLE), 0.0D)"
            b = bounds.domain_sum_sql(d, sd, k, n, N, q(a.name + "__lo"), q(a.name + "__hi"))
            out += [f"{d} * {N} / {n} AS {q(a.name)}", *[f"{b[x]} AS {q(a.name + '_' + x)}" for x in ("ci_low", "ci_high", "error_pct")]]
        else:
            m = f"try_divide(CAST({v} AS DOUBLE), {k})"
            e = bounds.avg_bound_sql(sd, k, f"({k} * {N} / {n})")["margin"]
            out += [f"{m} AS {q(a.name)}", f"{m} - {e} AS {q(a.name + '_ci_low')}", f"{m} + {e} AS {q(a.name + '_ci_high')}",
                    f"round(try_divide({e}, abs({m})) * 100, 2) AS {q(a.name + '_error_pct')}"]
    return agg.selectExpr(*out, n, N)
