"""Error bounds and accuracy maps as Spark column expressions.

Every bound is computed on the executors next to the aggregates that feed it
(one value per group row), never in a driver loop. The formulas are written
once as Spark SQL expression text (the ``*_sql`` functions) and turned into
columns with ``F.expr``: one driver call per output column instead of one
per arithmetic node, which keeps plan construction cheap.

Inputs are column names (or SQL expressions over columns) and Python
numbers. Undefined cases (empty sample, population of one) give NULL
instead of an error or an infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Operand = str | float | int

# Fixed values (must equal the reference for identical results):
#   z = 1.96 when the confidence is exactly 0.95, otherwise 2.576
#   accuracy -> HLL precision: >= 0.99 -> 16, >= 0.95 -> 14, >= 0.90 -> 12, else 10
#   accuracy -> sample rate: margin = (1 - accuracy) * mean * 2; rate 0.1 when
#     margin or mean is 0; otherwise (z * sd / margin)^2 / rows clamped to [0.05, 0.5]
#   stratified error: 1.96 * sqrt(p (1 - p) / n) * 100, p = n / N, 2 decimals
Z_95 = 1.96
Z_OTHER = 2.576
HLL_PRECISION_STEPS = ((0.99, 16), (0.95, 14), (0.90, 12))
HLL_PRECISION_FLOOR = 10
RATE_DEFAULT = 0.1
RATE_MIN = 0.05
RATE_MAX = 0.5


def z_value(confidence: float) -> float:
    return Z_95 if confidence == 0.95 else Z_OTHER


def sql(x: Operand) -> str:
    """SQL text of an operand: numbers become typed literals (``2.5D`` is a
    DOUBLE, a bare ``2.5`` would be DECIMAL), strings are column names or
    expressions and are parenthesised."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return f"{x}L" if abs(x) > 2_147_483_647 else str(x)
    if isinstance(x, float):
        return f"{x!r}D"
    if isinstance(x, str):
        return f"({x})"
    raise TypeError(f"pass a column name or a number, not {type(x).__name__}")


def _cols(d: dict[str, str]) -> dict[str, Column]:
    return {k: F.expr(v) for k, v in d.items()}


def _fpc(N: str, n: str) -> str:
    """Finite population correction sqrt((N-n)/(N-1)); 1 when N <= 1."""
    return f"(CASE WHEN {N} > 1 THEN sqrt(({N} - {n}) / ({N} - 1)) ELSE 1.0D END)"


# ------------------------------------------------------------------ COUNT
def count_bound_sql(n: Operand, rate: Operand, confidence: float = 0.95,
                    method: str = "proportion") -> dict[str, str]:
    """COUNT scaled from a Bernoulli sample of ``rate`` with ``n`` hits.

    ``method="proportion"`` reproduces the reference's margin
    ``z * sqrt(r (1 - r) / n) * fpc``; ``method="ht"`` is the
    Horvitz-Thompson relative error ``z * sqrt((1 - r) / n) * fpc``, the
    statistically sound (and wider) bound.
    """
    n, r, z = sql(n), sql(rate), sql(z_value(confidence))
    N = f"CAST(floor({n} / {r}) AS BIGINT)"
    if method == "proportion":
        core = f"sqrt({r} * (1.0D - {r}) / {n})"
    elif method == "ht":
        core = f"sqrt((1.0D - {r}) / {n})"
    else:
        raise ValueError(f"unknown method {method!r}")
    margin = f"(CASE WHEN {n} > 0 THEN {z} * {core} * {_fpc(N, n)} END)"
    return {
        "estimated_total": f"CASE WHEN {n} > 0 THEN {N} END",
        "error_pct": f"round({margin} * 100, 2)",
        "ci_low": f"CAST(floor({N} * (1.0D - {margin})) AS BIGINT)",
        "ci_high": f"CAST(floor({N} * (1.0D + {margin})) AS BIGINT)",
    }


def count_bound(n: Operand, rate: Operand, confidence: float = 0.95,
                method: str = "proportion") -> dict[str, Column]:
    return _cols(count_bound_sql(n, rate, confidence, method))


# ------------------------------------------------------------------ SUM / AVG
def sum_bound_sql(sample_sum: Operand, sample_std: Operand, n: Operand, N: Operand,
                  confidence: float = 0.95) -> dict[str, str]:
    """SUM scaled by N/n with a normal-approximation interval.

    NULL when the sample has fewer than two rows (no standard deviation) or
    the population has at most one row.
    """
    s, sd, n, N, z = sql(sample_sum), sql(sample_std), sql(n), sql(N), sql(z_value(confidence))
    ok = f"({n} > 1 AND {N} > 1)"
    total = f"(CASE WHEN {n} > 0 THEN {s} * {N} / {n} END)"
    margin = f"(CASE WHEN {ok} THEN {z} * ({N} * ({sd} / sqrt({n})) * {_fpc(N, n)}) END)"
    pct = f"(CASE WHEN {total} != 0 THEN {margin} / {total} * 100 WHEN {ok} THEN 0.0D END)"
    return {
        "estimated_total": f"round({total}, 2)",
        "error_pct": f"round({pct}, 2)",
        "ci_low": f"round({total} - {margin}, 2)",
        "ci_high": f"round({total} + {margin}, 2)",
    }


def sum_bound(sample_sum: Operand, sample_std: Operand, n: Operand, N: Operand,
              confidence: float = 0.95) -> dict[str, Column]:
    return _cols(sum_bound_sql(sample_sum, sample_std, n, N, confidence))


def sum_bound_ht_sql(sample_sum: Operand, sample_sumsq: Operand, rate: Operand,
                     confidence: float = 0.95) -> dict[str, str]:
    """SUM from a Bernoulli(rate) sample, Horvitz-Thompson interval.

    ``Var = (1 - r) / r^2 * sum(y^2)`` over the sampled rows. Unlike the
    fixed-sample-size formula above it includes the randomness of the
    sample size, which dominates when the mean is large next to the spread.
    """
    s, ss, r, z = sql(sample_sum), sql(sample_sumsq), sql(rate), sql(z_value(confidence))
    total = f"({s} / {r})"
    margin = f"({z} * sqrt((1.0D - {r}) / ({r} * {r}) * {ss}))"
    pct = f"(CASE WHEN {total} != 0 THEN {margin} / abs({total}) * 100 END)"
    return {
        "estimated_total": f"round({total}, 2)",
        "error_pct": f"round({pct}, 2)",
        "ci_low": f"round({total} - {margin}, 2)",
        "ci_high": f"round({total} + {margin}, 2)",
    }


def domain_spread_sql(total: Operand, spread: Operand, hits: Operand, sample_count: Operand) -> str:
    """Standard deviation of ``y`` over all ``sample_count`` sampled rows of a stratum, where
    the rows that do not match (or have no value) count as 0: from the ``hits`` values that do,
    their ``total`` and their own standard deviation ``spread``."""
    s, sd, k, n = sql(total), sql(spread), sql(hits), sql(sample_count)
    inner = f"coalesce({sd} * {sd} * ({k} - 1), 0.0D)"
    between = f"({s} / {k}) * ({s} / {k}) * {k} * ({n} - {k}) / {n}"
    return (f"(CASE WHEN {n} <= 1 THEN NULL WHEN {k} = {n} THEN {sd} WHEN {k} > 0 "
            f"THEN sqrt(({inner} + {between}) / ({n} - 1)) ELSE 0.0D END)")


def domain_sum_sql(total: Operand, spread: Operand, hits: Operand, sample_count: Operand,
                   population_count: Operand, least: Operand, most: Operand,
                   confidence: float = 0.95) -> dict[str, str]:
    """Interval of a stratum SUM over the rows that match a filter: ``total * N / n`` with the
    spread of ``y * matches`` over all sampled rows, so that not knowing how many rows match
    counts too.

    Where no sampled row matches, the SUM is 0 with an unknown relative error, and the most
    rows that can match (Wilson) times the ``least`` and ``most`` value of the stratum bound it.
    A stratum sampled as a whole is exact.
    """
    s, k, n, N = sql(total), sql(hits), sql(sample_count), sql(population_count)
    b = sum_bound_sql(total, domain_spread_sql(total, spread, hits, sample_count), sample_count,
                      population_count, confidence)
    rows = domain_count_interval_sql("0L", sample_count, population_count, confidence)["ci_high"]
    none = f"({k} = 0 AND {n} < {N})"
    whole = f"{n} >= {N}"
    low = f"round({rows} * least(coalesce({sql(least)}, 0.0D), 0.0D), 2)"
    high = f"round({rows} * greatest(coalesce({sql(most)}, 0.0D), 0.0D), 2)"
    return {
        "error_pct": f"CASE WHEN {none} THEN NULL WHEN {whole} THEN 0.0D ELSE abs({b['error_pct']}) END",
        "ci_low": f"CASE WHEN {none} THEN {low} WHEN {whole} THEN round({s}, 2) ELSE {b['ci_low']} END",
        "ci_high": f"CASE WHEN {none} THEN {high} WHEN {whole} THEN round({s}, 2) ELSE {b['ci_high']} END",
    }


def avg_sem_sql(sample_std: Operand, n: Operand, N: Operand) -> str:
    sd, n, N = sql(sample_std), sql(n), sql(N)
    return f"(CASE WHEN {n} > 1 AND {N} > 1 THEN ({sd} / sqrt({n})) * {_fpc(N, n)} END)"


def avg_bound_sql(sample_std: Operand, n: Operand, N: Operand,
                  confidence: float = 0.95) -> dict[str, str]:
    """Standard error and margin of a sample mean, with fpc (4 decimals)."""
    sem = avg_sem_sql(sample_std, n, N)
    return {"standard_error": f"round({sem}, 4)",
            "margin": f"round({sql(z_value(confidence))} * {sem}, 4)"}


def avg_bound(sample_std: Operand, n: Operand, N: Operand,
              confidence: float = 0.95) -> dict[str, Column]:
    return _cols(avg_bound_sql(sample_std, n, N, confidence))


# ------------------------------------------------------------------ strata
def stratum_error_pct_sql(sample_count: Operand, population_count: Operand) -> str:
    """Per-stratum error 1.96*sqrt(p(1-p)/n)*100 with p = n/N, 2 decimals."""
    n, N = sql(sample_count), sql(population_count)
    p = f"({n} / {N})"
    return f"round(CASE WHEN {n} > 0 THEN {sql(Z_95)} * sqrt({p} * (1.0D - {p}) / {n}) * 100 END, 2)"


def domain_count_error_pct_sql(hits: Operand, sample_count: Operand, population_count: Operand,
                               confidence: float = 0.95) -> str:
    """Relative error of a stratum COUNT estimated as ``hits * N / n``.

    The estimated share ``p = hits / n`` has standard error
    ``sqrt(p (1 - p) / n) * fpc``; relative to ``p`` that is
    ``sqrt((1 - p) / (p n)) * fpc`` - zero when every sampled row counts
    (an unfiltered COUNT(*) of a stratum is exact by construction).
    """
    v, n, N, z = sql(hits), sql(sample_count), sql(population_count), sql(z_value(confidence))
    p = f"({v} / {n})"
    return (f"round(CASE WHEN {v} > 0 THEN {z} * sqrt((1.0D - {p}) / ({p} * {n})) * "
            f"{_fpc(N, n)} * 100 END, 2)")


def domain_count_interval_sql(hits: Operand, sample_count: Operand, population_count: Operand,
                              confidence: float = 0.95) -> dict[str, str]:
    """Interval of a filtered stratum COUNT: Wilson's, on the share of sampled rows that match.

    It stays open at both ends - no sampled match leaves an upper bound, and all
    sampled rows matching leaves a lower bound below the stratum's size - and is
    cut to what the sample proves: at least the matches seen, at most all rows
    but the misses seen (so it is exact when the whole stratum was sampled).
    """
    v, n, N, z = sql(hits), sql(sample_count), sql(population_count), sql(z_value(confidence))
    p, z2 = f"({v} / {n})", f"({z} * {z})"
    centre = f"(({p} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = f"({z} / (1 + {z2} / {n}) * sqrt({p} * (1.0D - {p}) / {n} + {z2} / (4.0D * {n} * {n})))"
    low = f"greatest(CAST({v} AS BIGINT), CAST(floor({N} * ({centre} - {half})) AS BIGINT))"
    high = f"least(CAST({N} - {n} + {v} AS BIGINT), CAST(ceil({N} * ({centre} + {half})) AS BIGINT))"
    est = f"({v} * {N} / {n})"
    return {"ci_low": low, "ci_high": high,
            "error_pct": f"round(CASE WHEN {v} > 0 THEN greatest({high} - {est}, {est} - {low}) / {est} * 100 END, 2)"}


def stratum_error_pct(sample_count: Operand, population_count: Operand) -> Column:
    return F.expr(stratum_error_pct_sql(sample_count, population_count))


# ------------------------------------------------------------------ accuracy maps
def accuracy_to_rate_sql(accuracy: Operand, mean: Operand, stddev: Operand,
                         total_rows: Operand, confidence: float = 0.95) -> str:
    """Sample rate needed for a mean within ``(1-accuracy)*2`` relative margin; the
    default rate where mean or spread is unknown."""
    a, m, sd, N, z = sql(accuracy), sql(mean), sql(stddev), sql(total_rows), sql(z_value(confidence))
    margin = f"((1.0D - {a}) * {m} * 2)"
    clamped = f"greatest({sql(RATE_MIN)}, least({sql(RATE_MAX)}, pow({z} * {sd} / {margin}, 2) / {N}))"
    return (f"CASE WHEN {margin} = 0 OR {m} = 0 OR {m} IS NULL OR {sd} IS NULL OR {N} <= 0 "
            f"THEN {sql(RATE_DEFAULT)} ELSE {clamped} END")


def accuracy_to_rate(accuracy: Operand, mean: Operand, stddev: Operand,
                     total_rows: Operand, confidence: float = 0.95) -> Column:
    return F.expr(accuracy_to_rate_sql(accuracy, mean, stddev, total_rows, confidence))


def accuracy_to_rate_need(accuracy: float, mean: float | None, stddev: float | None,
                          total_rows: int, confidence: float = 0.95) -> float:
    """The sample rate that the target needs, before it is cut to the rates offered
    (unknown mean or spread: the default rate)."""
    margin = (1.0 - accuracy) * (mean or 0.0) * 2
    if not margin or stddev is None or total_rows <= 0:
        return RATE_DEFAULT
    return (z_value(confidence) * stddev / margin) ** 2 / total_rows


def count_error_pct_py(n: int, rate: float, confidence: float = 0.95, method: str = "ht") -> float:
    """Driver-side twin of the COUNT error of :func:`count_bound`."""
    core = (rate * (1 - rate) / n) ** 0.5 if method == "proportion" else ((1 - rate) / n) ** 0.5
    N = int(n // rate)
    fpc = ((N - n) / (N - 1)) ** 0.5 if N > 1 else 1.0
    return round(z_value(confidence) * core * fpc * 100, 2)


def accuracy_to_rate_py(accuracy: float, mean: float | None, stddev: float | None,
                        total_rows: int, confidence: float = 0.95) -> float:
    """Driver-side twin of :func:`accuracy_to_rate` for choosing a plan."""
    if not mean or stddev is None or total_rows <= 0 or accuracy == 1.0:
        return RATE_DEFAULT
    need = accuracy_to_rate_need(accuracy, mean, stddev, total_rows, confidence)
    return max(RATE_MIN, min(RATE_MAX, need))


def accuracy_to_hll_precision_sql(accuracy: Operand) -> str:
    a = sql(accuracy)
    steps = " ".join(f"WHEN {a} >= {sql(f)} THEN {p}" for f, p in HLL_PRECISION_STEPS)
    return f"CASE {steps} ELSE {HLL_PRECISION_FLOOR} END"


def accuracy_to_hll_precision(accuracy: Operand) -> Column:
    return F.expr(accuracy_to_hll_precision_sql(accuracy))


def accuracy_to_hll_precision_py(accuracy: float) -> int:
    for floor_acc, p in HLL_PRECISION_STEPS:
        if accuracy >= floor_acc:
            return p
    return HLL_PRECISION_FLOOR


def hll_error_pct_sql(precision: Operand) -> str:
    """Nominal HLL relative standard error 1.04 / sqrt(2^p), in percent."""
    return f"104.0D / sqrt(pow(2.0D, {sql(precision)}))"


def hll_error_pct(precision: Operand) -> Column:
    return F.expr(hll_error_pct_sql(precision))


def achieved_accuracy_sql(estimate: Operand, exact: Operand) -> str:
    """1 - |estimate - exact| / |exact|; NULL when the exact value is 0."""
    e, x = sql(estimate), sql(exact)
    return f"CASE WHEN {x} != 0 THEN 1.0D - abs({e} - {x}) / abs({x}) END"


def achieved_accuracy(estimate: Operand, exact: Operand) -> Column:
    return F.expr(achieved_accuracy_sql(estimate, exact))


def relative_error_sql(estimate: Operand, exact: Operand) -> str:
    e, x = sql(estimate), sql(exact)
    return f"CASE WHEN {x} != 0 THEN abs({e} - {x}) / abs({x}) END"


def tier_for_accuracy_sql(accuracy: Operand) -> str:
    """Stored tier chosen for an accuracy target: >=0.95 -> 20 %, >=0.90 -> 10 %, else 1 %."""
    a = sql(accuracy)
    return f"CASE WHEN {a} >= 0.95D THEN 0.2D WHEN {a} >= 0.9D THEN 0.1D ELSE 0.01D END"


def tier_for_accuracy(accuracy: Operand) -> Column:
    return F.expr(tier_for_accuracy_sql(accuracy))


def tier_for_accuracy_py(accuracy: float) -> float:
    if accuracy >= 0.95:
        return 0.20
    if accuracy >= 0.90:
        return 0.10
    return 0.01
