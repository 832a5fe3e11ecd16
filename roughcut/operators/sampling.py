"""Uniform sampling at query time (inventory C1-C6).

The sample sits directly on the base rows, below any filter or grouping.
Two samplers:

* ``method="hash"`` keeps ``h < floor(rate * 2^60)`` (see
  :mod:`roughcut.functions.hashing`). Reproducible and independent of the
  partition layout; a plain ``Filter`` that fuses into the scan's
  whole-stage-codegen stage, so nothing is shuffled.
* ``method="bernoulli"`` is Spark's ``Sample`` operator (``df.sample``):
  per-row Bernoulli trials, reproducible only for a fixed partitioning.

Aggregates are computed on the sample with partial (map-side) aggregation,
so only one partial row per group and partition crosses the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.frames import join_on_groups
from roughcut.functions.hashing import threshold, with_row_hash
from roughcut.operators.aggspec import Agg, as_aggs


def uniform_sample(df: DataFrame, rate: float, key: str | Sequence[str] | None = None,
                   method: str = "hash", seed: int = 42, h: str = "h",
                   hash_method: str = "md5") -> DataFrame:
    """Uniform row sample at ``rate``.

    Hash sampling needs the row key (or a stored ``h``, without NULLs) and
    raises without either; Spark's Bernoulli sampler is used on request only.
    """
    if method == "hash":
        df = with_row_hash(df, key, h, hash_method)
        return df.filter(F.col(h) < F.lit(threshold(rate)))
    if method == "bernoulli":
        return df.sample(withReplacement=False, fraction=float(rate), seed=seed)
    raise ValueError(f"unknown sampling method {method!r}")


def q(name: str) -> str:
    """Quote a column name for SQL expression text."""
    return "`" + name.replace("`", "``") + "`"


def agg_sql(a: Agg) -> str:
    """SQL text of one aggregate over the sample rows."""
    if a.func == "count":
        return "count(1)" if a.column == "*" else f"count({q(a.column)})"
    c = q(a.column)
    if a.func == "sum":
        return f"sum({c})"
    if a.func == "avg":
        # exact decimal/long sum divided in double: same value in every engine
        return f"CAST(sum({c}) AS DOUBLE) / count({c})"
    return f"{a.func}({c})"


def sample_aggregate(df: DataFrame, aggs, rate: float, group_by: Sequence[str] = (),
                     where: Column | None = None, key=None, method: str = "hash",
                     seed: int = 42, confidence: float = 0.95,
                     bound_method: str = "proportion", with_bounds: bool = True,
                     hash_method: str = "md5", all_groups: bool = False) -> DataFrame:
    """Aggregate over a runtime sample and scale to the population.

    The WHERE predicate applies to sampled rows (sample first); with hash
    sampling the order does not change the result, so Catalyst is free to
    push the predicate into the Parquet scan. See :func:`aggregate_sample`
    for the output columns.

    ``all_groups=True`` keeps the groups of ``df`` that no sampled row belongs
    to (see :func:`with_all_groups`); they cost a second, key-only pass.
    """
    rows = uniform_sample(df, rate, key, method, seed, hash_method=hash_method)
    res = aggregate_sample(rows, aggs, rate, group_by, where, confidence,
                           bound_method, with_bounds)
    if all_groups and group_by:
        groups = df.select(*group_by).distinct()
        res = with_all_groups(res, groups, aggs, group_by, rate, rate, confidence)
    return res


def aggregate_sample(rows: DataFrame, aggs, rate: float, group_by: Sequence[str] = (),
                     where: Column | None = None, confidence: float = 0.95,
                     bound_method: str = "proportion", with_bounds: bool = True,
                     population: int | None = None, sample_size: int | None = None) -> DataFrame:
    """Aggregate rows that already are a uniform sample at ``rate``.

    ``bound_method="proportion"`` reproduces the reference's COUNT and SUM
    bounds; ``"ht"`` gives Horvitz-Thompson intervals for both (COUNT:
    ``z*sqrt((1-r)/n)``; SUM: ``z*sqrt((1-r)/r^2 * sum(y^2))``), which hold
    their coverage when the reference's are too narrow.

    For every aggregate ``x`` the output carries ``x`` (population estimate:
    COUNT and SUM scaled by ``1/rate``, AVG/MIN/MAX as measured on the
    sample), ``x_sample`` (the raw sample value, for COUNT and SUM) and,
    for COUNT and SUM, ``x_error_pct``/``x_ci_low``/``x_ci_high``; AVG gets
    ``x_margin``. ``sample_rows`` is the number of sampled rows behind each
    output row.

    When the sample's exact size ``sample_size`` and its population size
    ``population`` are known (stored samples), COUNT and SUM scale by
    ``population / sample_size`` instead of ``1 / rate``.
    """
    aggs = as_aggs(aggs)
    group_by = list(group_by)
    if where is not None:
        rows = rows.filter(where)
    stats = ["count(1) AS sample_rows"]
    for a in aggs:
        stats.append(f"{agg_sql(a)} AS {q(a.name + '__s')}")
        if with_bounds and a.func in ("sum", "avg"):
            stats.append(f"stddev_samp({q(a.column)}) AS {q(a.name + '__sd')}")
        if with_bounds and a.func == "sum" and bound_method == "ht":
            y = f"CAST({q(a.column)} AS DOUBLE)"
            stats.append(f"sum({y} * {y}) AS {q(a.name + '__ss')}")
    stats = [F.expr(x) for x in stats]
    grouped = rows.groupBy(*group_by).agg(*stats) if group_by else rows.agg(*stats)

    n = "sample_rows"
    if population is not None and sample_size:
        def scale(v):
            return f"{v} * {bounds.sql(int(population))} / {bounds.sql(int(sample_size))}"
    else:
        def scale(v):
            return f"{v} / {bounds.sql(float(rate))}"
    n_hat = f"CASE WHEN {n} > 0 THEN floor({scale(n)}) END"
    out = [q(g) for g in group_by]
    for a in aggs:
        v, name = q(a.name + "__s"), q(a.name)
        if a.func == "count":
            out += [f"CAST(floor({scale(v)}) AS BIGINT) AS {name}", f"{v} AS {q(a.name + '_sample')}"]
            if with_bounds:
                b = bounds.count_bound_sql(v, float(rate), confidence, bound_method)
                out += [f"{b[k]} AS {q(a.name + '_' + k)}" for k in ("error_pct", "ci_low", "ci_high")]
        elif a.func == "sum":
            d = f"CAST({v} AS DOUBLE)"
            out += [f"{scale(d)} AS {name}", f"{d} AS {q(a.name + '_sample')}"]
            if with_bounds:
                if bound_method == "ht":
                    r_eff = (f"({bounds.sql(int(sample_size))} / {bounds.sql(int(population))})"
                             if population is not None and sample_size else bounds.sql(float(rate)))
                    b = bounds.sum_bound_ht_sql(d, q(a.name + "__ss"), r_eff, confidence)
                else:
                    b = bounds.sum_bound_sql(d, q(a.name + "__sd"), n, n_hat, confidence)
                out += [f"{b[k]} AS {q(a.name + '_' + k)}" for k in ("error_pct", "ci_low", "ci_high")]
        elif a.func == "avg":
            out.append(f"{v} AS {name}")
            if with_bounds:
                m = bounds.avg_bound_sql(q(a.name + "__sd"), n, n_hat, confidence)["margin"]
                out.append(f"{m} AS {q(a.name + '_margin')}")
        else:
            out.append(f"CAST({v} AS DOUBLE) AS {name}")
    out += [f"{n} AS sample_rows", f"{bounds.sql(float(rate))} AS sample_rate"]
    return grouped.selectExpr(*out)


def with_all_groups(res: DataFrame, groups: DataFrame, aggs, group_by: Sequence[str], realised: float,
                    rate: float, confidence: float = 0.95) -> DataFrame:
    """A grouped answer of :func:`aggregate_sample` completed to all of ``groups``: one that no
    sampled (matching) row belongs to has COUNT and SUM 0, unknown errors, and as many rows at
    most as leave the sample empty with the chance that the confidence allows."""
    full = join_on_groups(res, groups.select(*group_by), list(group_by))
    most = math.ceil(math.log(1 - confidence) / math.log1p(-realised)) if realised < 1.0 else 0
    cols = {"sample_rows": F.coalesce("sample_rows", F.lit(0).cast("long")),
            "sample_rate": F.lit(float(rate))}
    missed = F.col("sample_rows").isNull()
    for a in as_aggs(aggs):
        if a.func not in ("count", "sum"):
            continue
        zero = F.lit(0).cast("long" if a.func == "count" else "double")
        cols |= {a.name: F.when(missed, zero).otherwise(F.col(q(a.name))),
                 f"{a.name}_sample": F.when(missed, zero).otherwise(F.col(q(a.name + "_sample")))}
        if a.func == "count" and f"{a.name}_ci_high" in res.columns:
            cols |= {f"{a.name}_ci_low": F.when(missed, zero).otherwise(F.col(q(a.name + "_ci_low"))),
                     f"{a.name}_ci_high": F.when(missed, F.lit(most).cast("long")).otherwise(F.col(q(a.name + "_ci_high")))}
    return full.withColumns(cols).select(*res.columns)


def count_with_error(counts: DataFrame, count_col: str, rate: float,
                     confidence: float = 0.95, method: str = "proportion") -> DataFrame:
    """Attach a COUNT bound to every row of an aggregated result."""
    b = bounds.count_bound_sql(q(count_col), float(rate), confidence, method)
    return counts.selectExpr("*", *[f"{v} AS {k}" for k, v in b.items()])


def sample_stats(df: DataFrame, rates) -> DataFrame:
    """H4: population size and the expected sample size ``floor(N * r)`` for
    each rate, from one count of the table (one row per rate)."""
    n = df.agg(F.count(F.lit(1)).alias("population_size"))
    x = n.select("population_size", F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("sample_rate"))
    return x.select("population_size",
                    F.floor(F.col("population_size") * F.col("sample_rate")).cast("bigint").alias("sample_size"),
                    "sample_rate")
