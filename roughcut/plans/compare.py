"""Exact-versus-approximate comparison (inventory R4-R6).

Exact and approximate results are two lazy DataFrames joined on the group
key; both have one row per group, so the join is small and cannot skew.
Wall-clock timing belongs to the caller (see ``bench.py``), not to a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.frames import join_on_groups
from roughcut.operators.aggspec import SAMPLEABLE, as_aggs
from roughcut.operators.sampling import q
from roughcut.operators.samples import SampleStore
from roughcut.plans.aggregate import Plan, _run, approx_aggregate, exact_aggregate

ACCURACY_LEVELS = (0.85, 0.90, 0.95, 0.99)  # fixed value: the reference's sweep


def compare_frames(exact: DataFrame, approx: DataFrame, names: list[str],
                   group_by: list[str]) -> DataFrame:
    e = exact.select(*group_by, *[F.col(n).cast("double").alias(f"exact_{n}") for n in names])
    keep = [c for c in approx.columns if c not in group_by]
    a = approx.select(*group_by, *[F.col(c).alias(f"approx_{c}") if c in names else F.col(c)
                                   for c in keep])
    j = join_on_groups(e, a, group_by, "full_outer")
    out = [q(g) for g in group_by]
    for n in names:
        ex, ap = q(f"exact_{n}"), f"CAST({q(f'approx_{n}')} AS DOUBLE)"
        out += [ex, f"{ap} AS {q(f'approx_{n}')}",
                f"{bounds.relative_error_sql(ap, ex)} AS {q(f'rel_error_{n}')}",
                f"{bounds.achieved_accuracy_sql(ap, ex)} AS {q(f'accuracy_{n}')}"]
    extra = [q(c) for c in j.columns if c not in {f"exact_{n}" for n in names}
             and c not in {f"approx_{n}" for n in names} and c not in group_by]
    return j.selectExpr(*out, *extra)


def compare_exact_approx(df: DataFrame, aggs, group_by: Sequence[str] = (),
                         accuracy: float = 0.95, where: Column | None = None, **kw) -> DataFrame:
    """Exact and approximate side by side with relative error per value."""
    aggs = as_aggs(aggs)
    group_by = list(group_by)
    exact = exact_aggregate(df, aggs, group_by, where)
    approx, plan = approx_aggregate(df, aggs, group_by, accuracy, where, return_plan=True, **kw)
    approx = approx.select(*group_by, *[a.name for a in aggs])
    cmp = compare_frames(exact, approx, [a.name for a in aggs], group_by)
    return cmp.withColumn("strategy", F.lit(plan.strategy)).withColumn(
        "sample_rate", F.lit(plan.rate).cast("double"))


def compare_strategies(df: DataFrame, aggs, group_by: Sequence[str] = (),
                       rate: float = 0.1, where: Column | None = None,
                       key=None, table: str | None = None,
                       store: SampleStore | None = None,
                       confidence: float = 0.95) -> DataFrame:
    """Every strategy on the same request, each against the exact answer.

    Unsupported strategies appear as one row with ``supported = false``.
    """
    aggs = as_aggs(aggs)
    group_by = list(group_by)
    names = [a.name for a in aggs]
    sampleable = all(a.func in SAMPLEABLE for a in aggs)
    sketchable = any(a.func not in SAMPLEABLE for a in aggs)
    stored_tiers = store.available_tiers(table) if store is not None and table else []
    stored_strat = (tuple(group_by) in store.stratified_groups(table)
                    if store is not None and table and group_by else False)
    candidates = [
        ("uniform", sampleable, Plan("uniform", rate=rate)),
        ("stratified", sampleable and bool(group_by), Plan("stratified", rate=rate)),
        ("materialized_tier", sampleable and bool(stored_tiers),
         Plan("materialized_tier", rate=(rate if rate in stored_tiers else
                                         (max(stored_tiers) if stored_tiers else None)))),
        ("materialized_stratified", sampleable and stored_strat, Plan("materialized_stratified")),
        ("sketch", sketchable, Plan("sketch", hll_precision=14)),
    ]
    exact = exact_aggregate(df, aggs, group_by, where)
    parts = []
    unsupported = []
    for name, ok, plan in candidates:
        if not ok:
            unsupported.append(name)
            continue
        res = _run(df, aggs, group_by, where, key, table, store, plan, confidence)
        cmp = compare_frames(exact, res.select(*group_by, *names), names, group_by)
        # groups a sample missed still belong to this strategy and its rate
        parts.append(cmp.withColumn("strategy", F.lit(name)).withColumn("supported", F.lit(True))
                     .withColumn("sample_rate", F.lit(plan.rate).cast("double")))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if unsupported:
        flags = df.sparkSession.createDataFrame([(n, False) for n in unsupported],
                                                "strategy string, supported boolean")
        out = out.unionByName(flags, allowMissingColumns=True)
    return out


def accuracy_sweep(df: DataFrame, aggs, group_by: Sequence[str] = (),
                   accuracies: Sequence[float] = ACCURACY_LEVELS, **kw) -> DataFrame:
    """The same request at several accuracy targets, one block per target."""
    parts = [approx_aggregate(df, aggs, group_by, acc, **kw)
             .withColumn("accuracy_target", F.lit(float(acc))) for acc in accuracies]
    return reduce(lambda a, b: a.unionByName(b), parts)
