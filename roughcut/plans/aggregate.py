"""Aggregation with an accuracy target (inventory R1-R3, H7).

``approx_aggregate`` picks one of the sampling/sketch operators and returns
one lazy DataFrame. The driver reads only fixed-size facts: the list of stored
samples, the stated error of an answer from a stored sample, and - for runtime
sampling, on request - a few profile numbers.

Rules, in order:

1. a quantile or distinct aggregate -> ``sketch``: one pass with a KLL sketch
   per quantile column (its size follows the accuracy target) and an HLL
   sketch per distinct column (its precision follows the target); the other
   aggregates of the request are exact in the same pass;
2. fewer rows than ``small_table_rows``, where that is given -> ``exact``;
3. grouped, with a stored stratified sample on these columns ->
   ``materialized_stratified``;
4. stored tiers, and not grouped, or grouped by columns whose values are stored
   (a tier alone may lack groups) and not skewed (normalised Gini > 0.6) ->
   ``materialized_tier`` (tier by accuracy);
5. without ``runtime_sampling`` -> ``exact``: a sample drawn at query time
   reads the same bytes as the answer it estimates;
6. grouped by a skewed column -> ``stratified``, otherwise ``uniform``, at the
   rate that the accuracy target needs for the aggregated column; a need
   above the largest rate -> ``exact``.

An answer from a stored sample whose stated error exceeds the target goes to
the next larger tier, and from the last to ``exact``. Every group of the table is
in the answer; one that a sample has no (matching) row of has an unknown error, so
a stored sample that misses one does not keep any target.

Every strategy returns the same columns: the group columns, one estimate
per aggregate, ``<agg>_error_pct`` (NULL where no bound is defined),
``strategy`` and ``sample_rate``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.frames import join_on_groups, with_scalars
from roughcut.operators import profile as prof
from roughcut.operators import quantile, sampling, sketches, stratified
from roughcut.operators.aggspec import Agg, as_aggs
from roughcut.operators.heavy import skew_bounds
from roughcut.operators.samples import SampleStore, tier_name

STRATEGIES = ("exact", "uniform", "stratified", "materialized_tier", "materialized_stratified",
              "sketch")


ANSWER_ROWS = 10_000  # an answer of at most so many groups may pass through the driver


def quantile_rank_error(accuracy: float) -> float:
    """Rank error of quantiles at an accuracy target: 0.2 % of the rows at 0.95."""
    return (1.0 - accuracy) / 25


@dataclass
class Plan:
    strategy: str
    rate: float | None = None
    hll_precision: int | None = None
    quantile_k: int | None = None
    rank_error_pct: float | None = None
    reason: str = ""


def _numeric_stats(df: DataFrame, column: str | None):
    """Row count plus mean/stddev of one column in one aggregate (3 scalars)."""
    cols = [F.count(F.lit(1)).alias("n")]
    if column is not None:
        cols += [F.avg(F.col(column)).cast("double").alias("m"),
                 F.stddev_samp(F.col(column)).cast("double").alias("s")]
    row = df.agg(*cols).first()
    return row["n"], (row["m"] if column else None), (row["s"] if column else None)


def _planning_stats(df, value_col, table, store, profile_row, profile):
    """Row count, mean and stddev of the aggregated column, from the cheapest
    source: a given profile row, a stored profile DataFrame, the largest
    stored tier (population size from its metadata, moments from the
    sample), or - only without any of these - one pass over ``df``."""
    if profile_row is not None:
        return profile_row["row_count"], profile_row.get("mean"), profile_row.get("stddev"), "profile"
    if profile is not None:
        row = (profile if value_col is None else profile.filter(F.col("column_name") == value_col)).first()
        if row is not None and value_col is None:
            return row["row_count"], None, None, "profile"
        if row is not None:
            return row["row_count"], row["mean"], row["stddev"], "profile"
    tiers = store.available_tiers(table) if store is not None and table is not None else []
    if tiers:
        meta = store._meta_row(table, tier_name(max(tiers)))
        _, m, sd = _numeric_stats(store.tier(table, max(tiers)), value_col)
        return meta["population_rows"], m, sd, "stored sample"
    n, m, sd = _numeric_stats(df, value_col)
    return n, m, sd, "table scan"


def _table_rows(df, table, store, profile_row, profile) -> tuple[int, str]:
    """Row count from the cheapest source."""
    if profile_row is not None:
        return profile_row["row_count"], "profile"
    if profile is not None and (row := profile.first()) is not None:
        return row["row_count"], "profile"
    tiers = store.available_tiers(table) if store is not None and table is not None else []
    if tiers:
        return store._meta_row(table, tier_name(max(tiers)))["population_rows"], "stored sample"
    return df.count(), "table scan"


def _skew(df, group_by, table, store, tiers, profile_row, profile) -> float:
    """Normalised frequency Gini of the group columns, from the cheapest source."""
    if profile_row is not None and profile_row.get("group_gini_normalised") is not None:
        return profile_row["group_gini_normalised"]
    if profile is not None and len(group_by) == 1 and "group_gini_normalised" in profile.columns:
        row = profile.filter(F.col("column_name") == group_by[0]).first()
        if row is not None and row["group_gini_normalised"] is not None:
            return row["group_gini_normalised"]
    # group frequencies of a stored sample stand in for the table's
    rows = store.tier(table, max(tiers)) if tiers else df
    if len(group_by) == 1 and not tiers:
        # the frequent values often settle it, without a shuffle of all values
        bounded = skew_bounds(rows, group_by).first()
        if bounded is None or bounded["gini_high"] <= prof.SKEW_GINI:
            return bounded["gini_high"] if bounded else 0.0
        if bounded["gini_low"] > prof.SKEW_GINI:
            return bounded["gini_low"]
    return prof.frequency_gini(rows, group_by).first()["gini_normalised"] or 0.0


def choose_plan(df: DataFrame, aggs: list[Agg], group_by: list[str], accuracy: float,
                table: str | None, store: SampleStore | None,
                small_table_rows: int | None, confidence: float,
                profile_row: dict | None = None, profile: DataFrame | None = None,
                runtime_sampling: bool = False, has_key: bool = True) -> Plan:
    if any(a.is_quantile for a in aggs) or any(a.func == "count_distinct" for a in aggs):
        return sketch_plan(accuracy, reason="quantile or distinct aggregate")
    stored_here = store is not None and table is not None
    if small_table_rows:
        n, source = _table_rows(df, table, store, profile_row, profile)
        if n < small_table_rows:
            return Plan("exact", rate=1.0, reason=f"{n} rows < {small_table_rows} ({source})")
    if group_by and stored_here and tuple(group_by) in store.stratified_groups(table):
        return Plan("materialized_stratified", reason="stored stratified sample")
    tiers = store.available_tiers(table) if stored_here else []
    if tiers and group_by and store.known_groups(table, group_by) is None:
        # a tier alone does not tell which groups it has no row of
        if not runtime_sampling:
            return Plan("exact", rate=1.0, reason="no stored list of the groups")
        tiers = []
    skew = None
    if group_by and (tiers or runtime_sampling):
        skew = _skew(df, group_by, table, store, tiers, profile_row, profile)
    if tiers and (skew is None or skew <= prof.SKEW_GINI):
        want = bounds.tier_for_accuracy_py(accuracy)
        return Plan("materialized_tier", rate=want if want in tiers else max(tiers), reason="stored tier")
    if not runtime_sampling:
        return Plan("exact", rate=1.0, reason="a runtime sample reads the same bytes")
    if not has_key:
        raise ValueError("runtime sampling needs the row key (or a stored 'h' column)")
    value_col = next((a.column for a in aggs if a.column != "*"), None)
    n, mean, sd, source = _planning_stats(df, value_col, table, store, profile_row, profile)
    if bounds.accuracy_to_rate_need(accuracy, mean, sd, n, confidence) > bounds.RATE_MAX:
        return Plan("exact", rate=1.0, reason=f"the target needs more than a {bounds.RATE_MAX:.0%} sample ({source})")
    rate = bounds.accuracy_to_rate_py(accuracy, mean, sd, n, confidence)
    if group_by:
        return Plan("stratified" if skew > prof.SKEW_GINI else "uniform", rate=rate,
                    reason=f"normalised gini {skew}")
    return Plan("uniform", rate=rate, reason="rate from accuracy target")


def sketch_plan(accuracy: float, hll_precision: int | None = None, quantile_k: int | None = None,
                reason: str = "") -> Plan:
    """Sketch sizes for an accuracy target, or as asked for."""
    err = quantile_rank_error(accuracy)
    k = quantile_k or sketches.k_for(1 / max(err, 1e-6))
    pct = 100 * quantile.kll_rank_error(k) if quantile_k else 100 * err
    return Plan("sketch", hll_precision=hll_precision or bounds.accuracy_to_hll_precision_py(accuracy),
                quantile_k=k, rank_error_pct=round(pct, 4), reason=reason)


def _exact_expr(a: Agg) -> Column:
    c = None if a.column == "*" else F.col(a.column)
    if a.func == "count":
        return F.count(F.lit(1)) if c is None else F.count(c)
    if a.func == "sum":
        return F.sum(c).cast("double")
    if a.func == "avg":
        return F.sum(c).cast("double") / F.count(c)
    if a.func in ("min", "max"):
        return getattr(F, a.func)(c).cast("double")
    if a.func == "count_distinct":
        return F.count_distinct(c)
    raise ValueError("exact quantiles go through roughcut.operators.quantile")


def exact_aggregate(df: DataFrame, aggs, group_by: Sequence[str] = (),
                    where: Column | None = None) -> DataFrame:
    """Ground truth with the same output columns as the estimates.

    Exact quantiles use distributed selection
    (:mod:`roughcut.operators.quantile`) rather than Spark's single-task
    exact percentile; their one-row-per-group results are joined on the
    group key.
    """
    aggs = as_aggs(aggs)
    group_by = list(group_by)
    if where is not None:
        df = df.filter(where)
    plain = [a for a in aggs if not a.is_quantile]
    parts = []
    if plain or not aggs:
        cols = [_exact_expr(a).alias(a.name) for a in plain]
        parts.append(df.groupBy(*group_by).agg(*cols) if group_by else df.agg(*cols))
    for column in dict.fromkeys(a.column for a in aggs if a.is_quantile):
        own = [a for a in aggs if a.is_quantile and a.column == column]
        probs, names = [a.prob for a in own], [a.name for a in own]
        parts.append(quantile.exact_quantiles_grouped(df, group_by, column, probs, names=names)
                     if group_by else quantile.exact_quantiles(df, column, probs, names=names))
    res = parts[0]
    if not group_by:  # one row each: attach as scalars
        res = with_scalars(res, *parts[1:])
    for nxt in parts[1:] if group_by else []:
        res = join_on_groups(res, nxt, group_by)
    return res.select(*group_by, *[a.name for a in aggs])


def _finish(res: DataFrame, group_by, aggs: list[Agg], err: dict[str, Column],
            strategy: str, rate: float | None) -> DataFrame:
    out = [F.col(g) for g in group_by]
    for a in aggs:
        out.append(F.col(a.name))
        out.append(err.get(a.name, F.lit(None).cast("double")).cast("double")
                   .alias(f"{a.name}_error_pct"))
    out += [F.lit(strategy).alias("strategy"),
            F.lit(rate).cast("double").alias("sample_rate")]
    return res.select(*out)


def approx_aggregate(df: DataFrame, aggs, group_by: Sequence[str] = (),
                     accuracy: float = 0.95, where: Column | None = None,
                     key: str | Sequence[str] | None = None, table: str | None = None,
                     store: SampleStore | None = None,
                     small_table_rows: int | None = None,
                     confidence: float = 0.95, profile_row: dict | None = None,
                     profile: DataFrame | None = None, strategy: str | None = None,
                     sample_rate: float | None = None, hll_precision: int | None = None,
                     bound_method: str = "ht", hash_method: str = "xxhash",
                     return_plan: bool = False, runtime_sampling: bool = False,
                     quantile_k: int | None = None):
    """Answer ``aggs`` (grouped by ``group_by``) within an accuracy target,
    or with an explicitly requested ``strategy`` (and ``sample_rate`` /
    ``hll_precision`` / ``quantile_k``), which is taken as it is.

    Runtime samples (``runtime_sampling=True``, or requested) hash ``key`` with
    ``hash_method`` (``"xxhash"`` for speed, ``"md5"`` for SQL parity) unless
    ``df`` already carries ``h``. Stated COUNT and SUM errors of the sampling
    strategies are Horvitz-Thompson bounds by default (``bound_method="ht"``);
    pass ``"proportion"`` for the reference's narrower formulas.

    Planning a runtime sample needs the row count and the aggregated column's
    mean and spread (and, grouped, the group column's skew). They come from
    ``profile_row`` (``row_count``, ``mean``, ``stddev``, optionally
    ``group_gini_normalised``) or a stored ``profile`` DataFrame
    (:func:`roughcut.operators.profile.cached_profile`); failing that from
    the largest stored tier of ``table``; only without either from a pass
    over ``df`` - pass a profile when ``df`` is large.
    """
    aggs = as_aggs(aggs)
    group_by = list(group_by)

    def run(plan: Plan) -> DataFrame:
        return _run(df, aggs, group_by, where, key, table, store, plan, confidence, bound_method,
                    hash_method)
    if strategy is not None:
        # explicit request: skip the rules (``exact``, ``uniform``, ``stratified``,
        # ``materialized_tier``, ``materialized_stratified`` or ``sketch``)
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES}")
        rate = sample_rate if sample_rate is not None else (
            1.0 if strategy == "exact" else bounds.RATE_DEFAULT)
        plan = sketch_plan(accuracy, hll_precision, quantile_k, "requested")
        plan.strategy, plan.rate = strategy, rate
        res = run(plan)
    else:
        plan = choose_plan(df, aggs, group_by, accuracy, table, store, small_table_rows,
                           confidence, profile_row, profile, runtime_sampling,
                           key is not None or "h" in df.columns)
        if plan.strategy == "sketch" and (hll_precision or quantile_k):
            plan = sketch_plan(accuracy, hll_precision, quantile_k, plan.reason)
        plan, res = _within_target(run, plan, aggs, group_by, accuracy, where, table, store,
                                   confidence, bound_method)
    return (res, plan) if return_plan else res


def _within_target(run, plan: Plan, aggs: list[Agg], group_by: list[str], accuracy: float,
                   where, table, store, confidence: float, bound_method: str):
    """Take an answer from a stored sample only if its stated error keeps the target;
    else the next larger tier's, and at last the exact one. The store remembers which step
    a request took until its samples are built anew, so that a repeated request is planned
    without looking at data."""
    if not plan.strategy.startswith("materialized"):
        return plan, run(plan)
    request = (table, tuple(aggs), tuple(group_by), str(where), accuracy, confidence, bound_method,
               plan.strategy, plan.rate)
    if request in store.decisions:
        known = replace(store.decisions[request])
        return known, run(known)
    target = round((1.0 - accuracy) * 100, 6)
    names = [a.name for a in aggs if a.func in ("count", "sum", "avg")]
    steps = [plan]
    if plan.strategy == "materialized_tier":
        steps += [Plan("materialized_tier", rate=r, reason="larger tier for the target")
                  for r in store.available_tiers(table) if r > plan.rate]
    for step in steps:
        res = run(step)
        error = _known_error(step, aggs, group_by, where, table, store, confidence, bound_method)
        if error is None:
            # the answer is computed here; a small one is handed on, not computed again
            rows = res.limit(ANSWER_ROWS + 1).collect()
            if len(rows) <= ANSWER_ROWS:
                error = max((_worst(r, names) for r in rows), default=float("inf"))
                res = res.sparkSession.createDataFrame(rows, res.schema)
            else:
                errors = [F.coalesce(F.abs(F.col(f"{n}_error_pct")), F.lit(float("inf"))) for n in names]
                error = res.agg(F.max(F.greatest(F.lit(0.0), F.lit(0.0), *errors))).first()[0]
        if error <= target:
            store.decisions[request] = replace(step)
            return step, res
    exact = Plan("exact", rate=1.0, reason="no stored sample keeps the target")
    store.decisions[request] = replace(exact)
    return exact, run(exact)


def _worst(row, names: list[str]) -> float:
    """Largest stated error of a result row; an unknown one counts as infinite."""
    errors = [row[f"{n}_error_pct"] for n in names]
    return max((float("inf") if e is None else abs(e) for e in errors), default=0.0)


def _known_error(step: Plan, aggs: list[Agg], group_by: list[str], where, table, store,
                 confidence: float, bound_method: str) -> float | None:
    """The stated error where no data has to be read for it: that of a COUNT(*) of a whole
    tier follows from the registry. None: look at the answer."""
    if not any(a.func in ("count", "sum", "avg") for a in aggs):
        return 0.0
    if (step.strategy == "materialized_tier" and not group_by and where is None
            and all(a.func == "count" and a.column == "*" for a in aggs)):
        meta = store._meta_row(table, tier_name(step.rate))
        n, N = meta["sample_rows"], meta["population_rows"]
        return bounds.count_error_pct_py(n, n / N, confidence, bound_method) if n and N else float("inf")
    return None


def _sketch_answer(rows: DataFrame, aggs: list[Agg], group_by: list[str], plan: Plan):
    """All sketches and plain aggregates of a request in one two-level pass."""
    kll = F.kll_merge_agg_double
    parts, out, err = {}, [], {}
    for i, a in enumerate(aggs):
        c = F.lit(1) if a.column == "*" else F.col(a.column)
        err[a.name] = F.lit(0.0)
        if a.func == "count_distinct":
            parts[f"__p{i}"] = (sketches.hll_sketch(a.column, plan.hll_precision), sketches.hll_merged)
            out.append(F.hll_sketch_estimate(f"__p{i}").alias(a.name))
            err[a.name] = F.round(bounds.hll_error_pct(plan.hll_precision), 4)
        elif a.is_quantile:
            # one sketch for all probabilities of a column
            parts.setdefault(f"__kll_{a.column}", (sketches.kll_sketch(a.column, plan.quantile_k), kll))
            out.append(F.kll_sketch_get_quantile_double(F.col(f"`__kll_{a.column}`"), F.lit(float(a.prob))).alias(a.name))
            err[a.name] = F.lit(plan.rank_error_pct)
        elif a.func == "count":
            parts[f"__p{i}"] = (F.count(c), F.sum)
            out.append(F.coalesce(f"__p{i}", F.lit(0)).alias(a.name))
        elif a.func == "sum":
            parts[f"__p{i}"] = (F.sum(c), F.sum)
            out.append(F.col(f"__p{i}").cast("double").alias(a.name))
        elif a.func == "avg":
            parts[f"__p{i}"] = (F.sum(c), F.sum)
            parts[f"__n{i}"] = (F.count(c), F.sum)
            out.append(F.try_divide(F.col(f"__p{i}").cast("double"), F.col(f"__n{i}")).alias(a.name))
        else:
            fn = getattr(F, a.func)
            parts[f"__p{i}"] = (fn(c), fn)
            out.append(F.col(f"__p{i}").cast("double").alias(a.name))
    return sketches.tree_aggregate(rows, group_by, parts).select(*group_by, *out), err


def _run(df, aggs, group_by, where, key, table, store, plan: Plan, confidence,
         bound_method: str = "proportion", hash_method: str = "xxhash") -> DataFrame:
    s = plan.strategy
    if s == "exact":
        res = exact_aggregate(df, aggs, group_by, where)
        return _finish(res, group_by, aggs, {a.name: F.lit(0.0) for a in aggs}, s, 1.0)
    if s == "sketch":
        res, err = _sketch_answer(df if where is None else df.filter(where), aggs, group_by, plan)
        return _finish(res, group_by, aggs, err, s, None)
    if s in ("uniform", "materialized_tier"):
        if s == "uniform":
            res = sampling.sample_aggregate(df, aggs, plan.rate, group_by, where, key,
                                            confidence=confidence, bound_method=bound_method,
                                            hash_method=hash_method, all_groups=True)
        else:
            res = store.tier_aggregate(table, aggs, rate=plan.rate, where=where,
                                       confidence=confidence, bound_method=bound_method,
                                       group_by=group_by)
        err = {}
        for a in aggs:
            if a.func in ("count", "sum"):
                err[a.name] = F.col(f"{a.name}_error_pct")
            elif a.func == "avg":
                err[a.name] = F.when(F.col(a.name) != 0, F.round(
                    F.col(f"{a.name}_margin") / F.abs(F.col(a.name)) * 100, 2))
        return _finish(res, group_by, aggs, err, s, plan.rate)
    if s == "stratified":
        res = stratified.stratified_aggregate(df, group_by, aggs, plan.rate, key, where,
                                              hash_method=hash_method)
    elif s == "materialized_stratified":
        res = store.stratified_aggregate(table, group_by, aggs, where)
        meta = store._meta_row(table, "stratified", group_by)
        plan.rate = meta["rate"]
    else:
        raise ValueError(f"unknown strategy {s!r}")
    if bound_method == "proportion":  # the reference's per-stratum figure for every aggregate
        err = {a.name: F.col("error_pct") for a in aggs if a.func in ("count", "sum", "avg")}
    else:  # each estimate's own relative margin
        err = {a.name: F.col(f"{a.name}_error_pct") for a in aggs if a.func in ("count", "sum", "avg")}
    return _finish(res, group_by, aggs, err, s, plan.rate)
