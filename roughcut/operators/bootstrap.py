"""Poisson bootstrap: intervals for totals, ratios and quantiles of a sample (H1-H3, Q4).

Every sampled row gets a weight per replicate, Poisson(1) by inversion of 15 bits of a
hash of its key, and all replicates of all totals are sums of one aggregate: a single pass
over the sample, map-side combined, no row is copied, and a rerun on any partitioning
gives the same interval. What a formula cannot bound (a ratio of two sums, a median) gets
its interval from how the replicates scatter.

The sample is drawn without replacement at a rate r, and the replicates scatter as if r
were tiny; deviations are therefore scaled by ``sqrt(1 - r)``, which is exact for totals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.frames import join_on_groups, with_scalars
from roughcut.functions.hashing import with_row_hash
from roughcut.operators import sketches
from roughcut.operators.aggspec import Agg, as_aggs
from roughcut.operators.sampling import q
from roughcut.session import stored

REPLICATES = 100
QUANTILE_K = 4096  # KLL size that reads a quantile's value off its rank
GRID = 1000  # ranks at which the sketch is read
_BITS = 15  # of a weight's random number; four to a hash word


def poisson_thresholds(most: int = 8) -> list[int]:
    """Cumulative Poisson(1) probabilities below ``most`` in 32,768ths: a row whose 15 bits are
    below the k-th has weight k at most."""
    cdf = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(most)]
    return [round(c * (1 << _BITS)) for c in cdf]


@dataclass(frozen=True)
class Ratio:
    """``sum(top) / sum(bottom)`` over the rows where both have a value; SQL expressions."""

    name: str
    top: str
    bottom: str


def _weights(replicates: int, h: str, method: str) -> str:
    """SQL text of the array of a row's weights, one per replicate."""
    words = []
    for block in range(-(-replicates // 4)):
        if method == "md5":  # 2 x 60 bits of a digest
            text = f"substring(md5(concat(CAST({q(h)} AS STRING), ':{block // 2}')), {1 + 15 * (block % 2)}, 15)"
            words.append(f"CAST(conv({text}, 16, 10) AS BIGINT)")
        else:
            words.append(f"xxhash64({q(h)}, {block})")
    lanes = ", ".join(f"shiftrightunsigned(x, {_BITS * i}) & {(1 << _BITS) - 1}" for i in range(4))
    uniform = f"flatten(transform(array({', '.join(words)}), x -> array({lanes})))"
    cases = " ".join(f"WHEN u < {t} THEN {k}.0D" for k, t in enumerate(poisson_thresholds()))
    return f"transform({uniform}, u -> CASE {cases} ELSE 8.0D END)"


def _interval(values: str, estimate: str, rate: float, replicates: int, confidence: float) -> tuple[str, str]:
    """Percentile interval of an array of replicates, deviations scaled by sqrt(1 - rate)."""
    at = (replicates + 1) * (1 - confidence) / 2
    if at < 1:
        raise ValueError(f"{replicates} replicates are too few for confidence {confidence}")
    i, part = int(at), at - int(at)
    s = f"array_sort({values})"
    low = f"({s}[{i - 1}] + {part!r}D * ({s}[{i}] - {s}[{i - 1}]))"
    j = replicates - i
    high = f"({s}[{j}] - {part!r}D * ({s}[{j}] - {s}[{j - 1}]))"
    shrink = bounds.sql(math.sqrt(1 - rate))
    whole = f"forall({values}, x -> x IS NOT NULL)"
    return tuple(f"(CASE WHEN {whole} THEN {estimate} + {shrink} * ({e} - {estimate}) END)" for e in (low, high))


def bootstrap_aggregate(sample: DataFrame, aggs, rate: float, group_by: Sequence[str] = (),
                        key: str | Sequence[str] | None = None, h: str = "h", replicates: int = REPLICATES,
                        confidence: float = 0.95, hash_method: str = "md5") -> DataFrame:
    """Aggregates of a uniform ``sample`` drawn at ``rate``, scaled, with percentile intervals.

    ``aggs``: count, sum, avg, median and percentile (as elsewhere) and :class:`Ratio`. Rows
    are told apart by the hash ``h`` (or ``key``); rows of one key share their weights, so a key
    that names several rows is a cluster. ``hash_method="xxhash"`` takes several times less
    work per row than ``md5``.

    Per aggregate ``x``: ``x``, ``x_ci_low``, ``x_ci_high``, ``x_error_pct``; then ``sample_rows``.
    An interval is NULL where a replicate has nothing to divide by (a group of few rows). A
    sample of the whole table (rate 1) has intervals of no width. Groups without a sampled
    row are missing; an empty sample without groups gives one row of 0 and NULL.

    A quantile's interval turns the replicates of the share of rows up to the estimate into
    ranks, and reads the values at those ranks (in thousandths, outwards) from the KLL sketch that
    gave the estimate; the sketch's rank error is added on both sides. That takes a second pass over the sample.
    """
    if not 0 < rate <= 1:
        raise ValueError(f"rate must be in (0, 1], got {rate}")
    g = list(group_by)
    specs = [a if isinstance(a, Ratio) else as_aggs([a])[0] for a in aggs]
    had_rows = with_row_hash(sample, key, h, hash_method)
    rows = had_rows.withColumn("__w", F.expr(_weights(replicates, h, hash_method)))
    out = _totals(rows, [a for a in specs if isinstance(a, Ratio) or not a.is_quantile], rate, g, replicates, confidence)
    for a in specs:
        if not isinstance(a, Ratio) and a.is_quantile:
            out = join_on_groups(out, _quantile(had_rows, rows, a, rate, g, replicates, confidence), g, "left_outer")
    names = [f"{a.name}{x}" for a in specs for x in ("", "_ci_low", "_ci_high", "_error_pct")]
    return out.select(*g, *names, "sample_rows")


def _columns(name: str, est: str, low: str, high: str) -> list[str]:
    error = f"try_divide(greatest({high} - {est}, {est} - {low}), abs({est})) * 100"
    return [f"{est} AS {q(name)}", f"{low} AS {q(name + '_ci_low')}", f"{high} AS {q(name + '_ci_high')}",
            f"round({error}, 4) AS {q(name + '_error_pct')}"]


def _totals(rows: DataFrame, specs: list, rate: float, g: list[str], replicates: int, confidence: float) -> DataFrame:
    terms: dict[str, str] = {}  # SQL of a summand -> its name

    def total(e: str) -> str:
        return terms.setdefault(e, f"__t{len(terms)}")

    wanted = []
    for a in specs:
        if isinstance(a, Ratio):
            both = f"({a.top}) IS NOT NULL AND ({a.bottom}) IS NOT NULL"
            wanted.append((a.name, total(f"CASE WHEN {both} THEN CAST({a.top} AS DOUBLE) END"),
                           total(f"CASE WHEN {both} THEN CAST({a.bottom} AS DOUBLE) END")))
            continue
        if a.func not in ("count", "sum", "avg"):
            raise ValueError("the bootstrap answers count, sum, avg, quantiles and ratios")
        one = "1.0D" if a.column == "*" else f"CASE WHEN {q(a.column)} IS NOT NULL THEN 1.0D END"
        y = one if a.func == "count" else f"CAST({q(a.column)} AS DOUBLE)"
        wanted.append((a.name, total(y), total(one) if a.func == "avg" else None))
    rows = rows.selectExpr(*[q(c) for c in g], "__w", *[f"{e} AS {t}" for e, t in terms.items()])
    aggs = [F.count("*").alias("sample_rows")]
    for t in terms.values():
        each = ", ".join(f"coalesce(sum(__w[{b}] * {t}), 0.0D)" for b in range(replicates))
        aggs += [F.expr(f"array({each})").alias(t + "r"), F.expr(f"coalesce(sum({t}), 0.0D)").alias(t)]
    sums = rows.groupBy(*g).agg(*aggs) if g else rows.agg(*aggs)
    # values of the replicates first, so that the interval's text is short
    reps, out = [], [q(c) for c in g]
    for i, (name, top, bottom) in enumerate(wanted):
        if bottom is None:
            reps += [f"{top} / {bounds.sql(rate)} AS __e{i}", f"transform({top}r, x -> x / {bounds.sql(rate)}) AS __v{i}"]
        else:
            reps += [f"try_divide({top}, {bottom}) AS __e{i}",
                     f"zip_with({top}r, {bottom}r, (x, y) -> try_divide(x, y)) AS __v{i}"]
        out += _columns(name, f"__e{i}", *_interval(f"__v{i}", f"__e{i}", rate, replicates, confidence))
    return sums.selectExpr(*[q(c) for c in g], *reps, "sample_rows").selectExpr(*out, "sample_rows")


def _quantile(plain: DataFrame, rows: DataFrame, a: Agg, rate: float, g: list[str], replicates: int,
              confidence: float) -> DataFrame:
    p, eps = a.prob, 2.446 / QUANTILE_K ** 0.9433
    there = plain.where(F.col(a.column).isNotNull())
    grid = ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1))  # ranks must be constants
    at = stored(sketches.kll_sketches(there, a.column, g, QUANTILE_K, "__sk").withColumn(
        "__q", F.expr(f"CASE WHEN kll_sketch_get_n_double(__sk) > 0 THEN kll_sketch_get_quantile_double(__sk, {p!r}D) END"))
        .withColumn("__grid", F.expr(f"CASE WHEN __q IS NOT NULL THEN kll_sketch_get_quantile_double(__sk, array({grid})) END"))
        .drop("__sk"), "quantile")
    y = f"CAST({q(a.column)} AS DOUBLE)"
    weighed = rows.where(F.col(a.column).isNotNull())
    if g:
        points = at.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], "__q")
        same = reduce(lambda x, c: x & c, [weighed[c].eqNullSafe(points[f"__g{i}"]) for i, c in enumerate(g)])
        weighed = weighed.join(points, same)
    else:
        weighed = with_scalars(weighed, at.select("__q"))
    below = f"CASE WHEN {y} <= __q THEN 1.0D ELSE 0.0D END"
    sums = ["avg(" + below + ") AS __p", "array(" + ", ".join(
        f"try_divide(sum(__w[{b}] * {below}), sum(__w[{b}]))" for b in range(replicates)) + ") AS __v"]
    sums = [F.expr(s) for s in sums]
    shares = weighed.groupBy(*g).agg(*sums) if g else weighed.agg(*sums)
    low, high = _interval("__v", "__p", rate, replicates, confidence)
    ranks = shares.selectExpr(*[q(c) for c in g], f"greatest(0.0D, {p!r}D - ({high} - __p) - {eps!r}D) AS __lo",
                              f"least(1.0D, {p!r}D - ({low} - __p) + {eps!r}D) AS __hi")
    read = join_on_groups(at, ranks, g, "left_outer")
    ends = [f"__grid[CAST({to}({r} * {GRID}) AS INT)]" for r, to in (("__lo", "floor"), ("__hi", "ceil"))]
    return read.selectExpr(*[q(c) for c in g], *_columns(a.name, "__q", *ends))
