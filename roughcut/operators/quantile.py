"""Exact quantiles that never hold a whole column in one task (B8-B10 at scale).

Spark's exact ``percentile``/``median`` keeps a map of every distinct value
and merges it in a single final task; on a 100 TB column that task holds the
column. Here the exact order statistics are found by distributed selection,
for any number of probabilities at once:

1. count the values (target ranks follow from N and p) and build a KLL sketch
   of them - merged in two levels, so no task merges more than a bounded
   number of partial sketches;
2. read two pivots around each target rank from the sketch, with a safety
   margin, and count in one pass the values below, equal to, between and
   equal to the pivots; the same pass sketches the values strictly between;
3. a rank that falls on a pivot is resolved, whatever the size of that run of
   ties; any other goes on strictly between two known values, with exact
   counts on both sides - also when the sketch missed. Every round takes the
   pivots' own rows away, so it always gets on;
4. once at most ``small`` rows are left between the bounds of a rank, rank
   them in one window over that bounded set.

NaN is counted apart and ranked last, as SQL orders it. Ranks follow the SQL
definitions: ``cont`` interpolates linearly at ``p * (N - 1)``, ``disc``
returns the value of rank ``max(1, ceil(p * N))``. Every pass reads one pruned
column; ungrouped, the driver sees a few scalars per round and target.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roughcut.operators.sketches import TREE_FANIN
from roughcut.session import stored

SMALL = 100_000
KLL_K = 2000
MAX_MARGIN = 0.25
GRID = 1000  # sketch quantiles at ranks 0, 1/GRID, ..., 1
GRID_G = 200  # per-group grid (kept small: it lives in the per-group state)


def kll_rank_error(k: int) -> float:
    """Normalised rank error of a KLL sketch (double-sided, 99 % confidence),
    the published DataSketches fit ``2.446 / k^0.9433``."""
    return 2.446 / k ** 0.9433


def _ranks(n: int, p: float, kind: str) -> tuple[int, int, float]:
    """1-based ranks (lo, hi) and the interpolation position."""
    if kind == "disc":
        k = max(1, math.ceil(p * n))
        return k, k, float(k - 1)
    pos = p * (n - 1)
    return math.floor(pos) + 1, math.ceil(pos) + 1, pos


def _check(probs: Sequence[float], kind: str) -> None:
    if not all(0.0 <= p <= 1.0 for p in probs):
        raise ValueError("p must be in [0, 1]")
    if kind not in ("cont", "disc"):
        raise ValueError("kind is 'cont' or 'disc'")


def _between(lo: float | None, hi: float | None) -> Column:
    x, c = F.col("x"), F.lit(True)
    if lo is not None:
        c = c & (x > F.lit(lo))
    return c if hi is None else c & (x < F.lit(hi))


@dataclass
class _Bracket:
    """Target ranks strictly between two values: ``below`` rows are at most ``lo``, ``size``
    rows lie between; ``grid`` are sketch quantiles of those, when known."""
    lo: float | None
    hi: float | None
    below: int
    size: int
    ranks: list[int]
    margin: float
    grid: list[float] | None = None
    pivots: list[tuple[float | None, float | None, list[int]]] = field(default_factory=list)

    def choose(self) -> None:
        """Pivots for each rank; ranks with equal pivots share them."""
        if self.grid is None:  # sketch first
            self.pivots = [(self.lo, self.hi, self.ranks)]
            return
        by: dict[tuple, list[int]] = {}
        for r in self.ranks:
            at = (r - self.below) / self.size
            low = self.grid[max(0, math.floor((at - self.margin) * GRID))]
            high = self.grid[min(GRID, math.ceil((at + self.margin) * GRID))]
            by.setdefault((low, high), []).append(r)
        self.pivots = [(low, high, ranks) for (low, high), ranks in by.items()]


def _pass(vals: DataFrame, requests: list[tuple[_Bracket, float | None, float | None]], k: int) -> list:
    """One pass for all requests: rows of the bracket below the first pivot, equal to it,
    strictly between the pivots, and equal to the second; and the grid of those between.
    A pivot that is the bracket's own bound has nothing below or equal to it inside."""
    x = F.col("x")
    salted = vals.withColumn("__b", F.pmod(F.spark_partition_id(), F.lit(TREE_FANIN)))
    one, two, out = [], [], []
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    for i, (b, low, high) in enumerate(requests):
        inside, mid = _between(b.lo, b.hi), _between(low, high)
        none = F.lit(False)
        parts = {"lt": none if low == b.lo else inside & (x < F.lit(low)),
                 "el": none if low == b.lo else inside & (x == F.lit(low)),
                 "mid": inside & mid,
                 "eh": none if high == b.hi or high == low else inside & (x == F.lit(high))}
        for name, c in parts.items():
            one.append(F.count_if(c).alias(f"{name}{i}"))
            two.append(F.coalesce(F.sum(f"{name}{i}"), F.lit(0)).alias(f"{name}{i}"))
        one.append(F.kll_sketch_agg_double(F.when(parts["mid"], x), k).alias(f"sk{i}"))
        two.append(F.kll_merge_agg_double(F.when(F.col(f"mid{i}") > 0, F.col(f"sk{i}"))).alias(f"sk{i}"))
        out += [*[F.col(f"{name}{i}") for name in parts], F.when(
            F.col(f"mid{i}") > 0, F.kll_sketch_get_quantile_double(f"sk{i}", grid)).alias(f"qs{i}")]
    row = salted.groupBy("__b").agg(*one).agg(*two).select(*out).first()
    return [tuple(row[f"{n}{i}"] for n in ("lt", "el", "mid", "eh", "qs")) for i in range(len(requests))]


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], kind: str = "cont",
                    names: Sequence[str] | None = None, small: int = SMALL,
                    k: int = KLL_K) -> DataFrame:
    """One-row DataFrame with the exact quantiles ``probs`` of ``column``.

    All probabilities share every pass. A column without values gives NULLs.
    """
    probs = list(probs)
    _check(probs, kind)
    names = list(names) if names else [f"{kind}_{column}_{i}" for i in range(len(probs))]
    spark = df.sparkSession
    every = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    vals = every.filter(~F.isnan("x"))
    rows, nans = every.agg(F.count("x"), F.count_if(F.isnan("x"))).first()
    if rows == 0:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])
    targets = [_ranks(rows, p, kind) for p in probs]
    wanted = sorted({r for lo, hi, _ in targets for r in (lo, hi)})
    value = {r: float("nan") for r in wanted if r > rows - nans}
    first = [r for r in wanted if r not in value]
    brackets = [_Bracket(None, None, 0, rows - nans, first, kll_rank_error(k))] if first else []

    while any(b.size > small for b in brackets):
        wide = [b for b in brackets if b.size > small]
        for b in wide:
            b.choose()
        requests = [(b, low, high, ranks) for b in wide for low, high, ranks in b.pivots]
        counted = _pass(vals, [q[:3] for q in requests], k)
        after: dict[tuple, _Bracket] = {(b.lo, b.hi): b for b in brackets if b.size <= small}

        def go_on(lo, hi, below, size, rank, margin, grid=None):
            b = after.setdefault((lo, hi), _Bracket(lo, hi, below, size, [], margin, grid))
            b.ranks.append(rank)

        for (b, low, high, ranks), (lt, el, mid, eh, grid) in zip(requests, counted):
            wider = min(MAX_MARGIN, 2 * b.margin)
            for r in ranks:
                at = r - b.below
                if at <= lt:
                    go_on(b.lo, low, b.below, lt, r, wider)
                elif at <= lt + el:
                    value[r] = low
                elif at <= lt + el + mid:
                    go_on(low, high, b.below + lt + el, mid, r, b.margin, grid)
                elif at <= lt + el + mid + eh:
                    value[r] = high
                else:
                    done = lt + el + mid + eh
                    go_on(high, b.hi, b.below + done, b.size - done, r, wider)
        brackets = list(after.values())

    if brackets:
        value |= _read(vals, brackets)

    def result(lo: int, hi: int, pos: float) -> float:
        if lo == hi or value[lo] == value[hi]:
            return value[lo]
        return (math.ceil(pos) - pos) * value[lo] + (pos - math.floor(pos)) * value[hi]
    return spark.range(1).select(*[F.lit(result(*t)).cast("double").alias(n) for t, n in zip(targets, names)])


def _read(vals: DataFrame, brackets: list[_Bracket]) -> dict[int, float]:
    """Values of the ranks that are left, from at most ``small`` rows per bracket."""
    which = F.array_compact(F.array(*[F.when(_between(b.lo, b.hi), F.lit(i)) for i, b in enumerate(brackets)]))
    runs = vals.select("x", F.explode(which).alias("b")).groupBy("b", "x").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("last", upto)
    hit = F.lit(False)
    for i, b in enumerate(brackets):
        for r in b.ranks:
            at = r - b.below
            hit = hit | ((F.col("b") == i) & (F.col("last") >= at) & (F.col("last") - F.col("c") < at))
    found = runs.filter(hit).collect()  # at most one row per target rank
    return {r: row["x"] for i, b in enumerate(brackets) for r in b.ranks for row in found
            if row["b"] == i and row["last"] - row["c"] < r - b.below <= row["last"]}


def exact_quantile(df: DataFrame, column: str, p: float, kind: str = "cont",
                   alias: str | None = None, small: int = SMALL, k: int = KLL_K) -> DataFrame:
    """One-row DataFrame holding the exact quantile ``p`` of ``column``."""
    return exact_quantiles(df, column, [p], kind, [alias or f"{kind}_{column}"], small, k)


# ------------------------------------------------------------------ grouped
def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL is a value like any other."""
    r = right.select(*[F.col(c).alias(f"__k_{c}") for c in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for c in keys:
        eq = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        cond = eq if cond is None else cond & eq
    return left.join(r, cond, how).drop(*[f"__k_{c}" for c in keys])


_BOUNDS = ("lo", "hi")
_PIVOTS = ("nlo", "nhi")


def _grouped_pass(vals: DataFrame, requests: DataFrame, g: list[str], k: int) -> DataFrame:
    """The pass of :func:`_pass` for a table of requests: a row per group, bracket and pivots."""
    x, low, high = F.col("x"), F.col("nlo"), F.col("nhi")

    def above(c: str) -> Column:
        return F.col(c).isNull() | (x > F.col(c))

    def under(c: str) -> Column:
        return F.col(c).isNull() | (x < F.col(c))
    rows = _null_safe(vals, requests, g).filter(above("lo") & under("hi"))
    mid = above("nlo") & under("nhi")
    keys = [*g, *_BOUNDS, *_PIVOTS]
    level1 = rows.withColumn("__b", F.pmod(F.spark_partition_id(), F.lit(TREE_FANIN))) \
        .groupBy(*keys, "__b").agg(
            F.count_if(x < low).alias("lt"), F.count_if(x == low).alias("el"),
            F.count_if(mid).alias("mid"), F.count_if((x == high) & ~low.eqNullSafe(high)).alias("eh"),
            F.kll_sketch_agg_double(F.when(mid, x), k).alias("sk"))
    level2 = level1.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("lt", "el", "mid", "eh")],
        F.kll_merge_agg_double(F.when(F.col("mid") > 0, F.col("sk"))).alias("sk"))
    grid = F.array(*[F.lit(i / GRID_G) for i in range(GRID_G + 1)])
    return level2.select(*keys, "lt", "el", "mid", "eh", F.when(
        F.col("mid") > 0, F.kll_sketch_get_quantile_double("sk", grid)).alias("mgrid"))


def exact_quantiles_grouped(df: DataFrame, group_by, column: str, probs: Sequence[float],
                            kind: str = "cont", names: Sequence[str] | None = None,
                            small: int = SMALL, k: int = KLL_K) -> DataFrame:
    """Exact quantiles per group, without holding a hot group in one task.

    The selection of :func:`exact_quantiles` for all groups at once: the state
    is a table with a row per group and target rank, stored after each round.
    Groups of at most ``small`` values skip the rounds, so the table that rows
    meet in a round has at most N / ``small`` groups; it is joined by its size.
    A group whose values are all NULL has no row in the result.
    """
    g = [group_by] if isinstance(group_by, str) else list(group_by)
    probs = list(probs)
    _check(probs, kind)
    names = list(names) if names else [f"{kind}_{column}_{i}" for i in range(len(probs))]
    every = df.select(*g, F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    vals = every.filter(~F.isnan("x"))
    sizes = every.groupBy(*g).agg(F.count("x").alias("n"), F.count_if(F.isnan("x")).alias("nans"))
    n = F.col("n")
    if kind == "disc":
        def ranks(p: float) -> tuple[Column, Column, Column]:
            r = F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * n)).cast("bigint")
            return r, r, (r - 1).cast("double")
    else:
        def ranks(p: float) -> tuple[Column, Column, Column]:
            pos = F.lit(float(p)) * (n - 1)
            return (F.floor(pos) + 1).cast("bigint"), (F.ceil(pos) + 1).cast("bigint"), pos.cast("double")
    if (sizes.agg(F.max("n")).first()[0] or 0) <= small:
        return _small_groups(every, g, [ranks(p) for p in probs], names)
    sizes = stored(sizes, "quantiles", "sizes")
    targets = sizes.select(*g, "n", "nans", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), *[c.alias(a) for c, a in zip(ranks(p), ("r1", "r2", "pos"))])
        for i, p in enumerate(probs)])).alias("t")).select(*g, "n", "nans", "t.*")
    none = F.lit(None).cast("double")
    state = targets.select(*g, "n", "nans", F.explode(F.array("r1", "r2")).alias("rank")).distinct().select(
        *g, "rank", none.alias("lo"), none.alias("hi"), F.lit(0).cast("bigint").alias("below"),
        (F.col("n") - F.col("nans")).alias("size"), F.lit(kll_rank_error(k)).alias("margin"),
        F.array().cast("array<double>").alias("grid"),
        F.when(F.col("rank") > F.col("n") - F.col("nans"), F.lit(float("nan"))).alias("value"))
    step = F.lit(float(GRID_G))
    wide = F.col("value").isNull() & (F.col("size") > small)
    state = stored(state, "quantiles", "state")
    while not state.filter(wide).isEmpty():
        at = (F.col("rank") - F.col("below")) / F.col("size")
        j_lo = F.greatest(F.lit(0), F.floor((at - F.col("margin")) * step)).cast("int")
        j_hi = F.least(F.lit(GRID_G), F.ceil((at + F.col("margin")) * step)).cast("int")
        known = F.size("grid") > 0
        asked = state.filter(wide).withColumn("nlo", F.when(known, F.get("grid", j_lo)).otherwise(F.col("lo"))) \
            .withColumn("nhi", F.when(known, F.get("grid", j_hi)).otherwise(F.col("hi")))
        asked = stored(asked, "quantiles", "asked")
        counted = _grouped_pass(vals, asked.select(*g, *_BOUNDS, *_PIVOTS).distinct(), g, k)
        j = _null_safe(asked, counted, [*g, *_BOUNDS, *_PIVOTS])
        t = F.col("rank") - F.col("below")
        upto = [F.col("lt"), F.col("lt") + F.col("el"), F.col("lt") + F.col("el") + F.col("mid"),
                F.col("lt") + F.col("el") + F.col("mid") + F.col("eh")]
        left, on_lo, between, on_hi = (t <= u for u in upto)
        wider = F.least(F.lit(MAX_MARGIN), F.col("margin") * 2)
        empty = F.array().cast("array<double>")

        def by(a, b, c, d, e) -> Column:
            """Pick by where the rank fell: below, on the first pivot, between, on the second, above."""
            return F.when(left, a).when(on_lo, b).when(between, c).when(on_hi, d).otherwise(e)
        moved = j.select(
            *g, "rank",
            by(F.col("lo"), F.col("lo"), F.col("nlo"), F.col("lo"), F.col("nhi")).alias("lo"),
            by(F.col("nlo"), F.col("hi"), F.col("nhi"), F.col("hi"), F.col("hi")).alias("hi"),
            by(F.col("below"), F.col("below"), F.col("below") + upto[1], F.col("below"),
               F.col("below") + upto[3]).cast("bigint").alias("below"),
            by(F.col("lt"), F.col("size"), F.col("mid"), F.col("size"), F.col("size") - upto[3])
            .cast("bigint").alias("size"),
            by(wider, F.col("margin"), F.col("margin"), F.col("margin"), wider).alias("margin"),
            by(empty, empty, F.coalesce("mgrid", empty), empty, empty).alias("grid"),
            F.when(left, none).when(on_lo, F.col("nlo")).when(between, none).when(on_hi, F.col("nhi"))
            .alias("value"))
        state = stored(state.filter(~wide).unionByName(moved), "quantiles", "state")

    # what is left: at most `small` rows per group and bracket
    left_over = state.filter(F.col("value").isNull())
    spans = left_over.select(*g, *_BOUNDS).distinct()
    inside = _null_safe(vals, spans, g).filter(
        (F.col("lo").isNull() | (F.col("x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") < F.col("hi"))))
    runs = inside.groupBy(*g, *_BOUNDS, "x").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*g, *_BOUNDS).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("last", F.sum("c").over(w))
    read = _null_safe(runs, left_over.select(*g, *_BOUNDS, "rank", "below"), [*g, *_BOUNDS]).filter(
        (F.col("last") >= F.col("rank") - F.col("below"))
        & (F.col("last") - F.col("c") < F.col("rank") - F.col("below"))).select(*g, "rank", F.col("x").alias("value"))
    values = state.filter(F.col("value").isNotNull()).select(*g, "rank", "value").unionByName(read)
    both = _null_safe(targets, values.withColumnRenamed("rank", "r1").withColumnRenamed("value", "v1"), [*g, "r1"])
    both = _null_safe(both, values.withColumnRenamed("rank", "r2").withColumnRenamed("value", "v2"), [*g, "r2"])
    lower, higher, pos = F.floor("pos"), F.ceil("pos"), F.col("pos")
    result = F.when((F.col("r1") == F.col("r2")) | (F.col("v1") == F.col("v2")), F.col("v1")).otherwise(
        (higher - pos) * F.col("v1") + (pos - lower) * F.col("v2"))
    return both.withColumn("q", result).groupBy(*g).agg(
        *[F.max(F.when(F.col("i") == i, F.col("q"))).alias(name) for i, name in enumerate(names)])


def _small_groups(every: DataFrame, g: list[str], targets: list[tuple[Column, Column, Column]],
                  names: list[str]) -> DataFrame:
    """Quantiles of groups that each fit the last step: one window over a group's distinct
    values (NaN last) and their counts."""
    runs = every.groupBy(*g, "x").agg(F.count("*").alias("c"))
    group = Window.partitionBy(*g)
    runs = runs.withColumn("last", F.sum("c").over(group.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("n", F.sum("c").over(group))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("last") >= rank) & (F.col("last") - F.col("c") < rank), F.col("x")))
    out = runs.groupBy(*g).agg(*[c for i, (r1, r2, pos) in enumerate(targets) for c in (
        at(r1).alias(f"__a{i}"), at(r2).alias(f"__b{i}"), F.max(pos).alias(f"__p{i}"))])

    def result(i: int) -> Column:
        a, b, pos = F.col(f"__a{i}"), F.col(f"__b{i}"), F.col(f"__p{i}")
        return F.when(a == b, a).otherwise((F.ceil(pos) - pos) * a + (pos - F.floor(pos)) * b)
    return out.select(*g, *[result(i).alias(name) for i, name in enumerate(names)])


def exact_quantile_grouped(df: DataFrame, group_by, column: str, p: float,
                           kind: str = "cont", alias: str | None = None,
                           small: int = SMALL, k: int = KLL_K) -> DataFrame:
    """One exact quantile per group (see :func:`exact_quantiles_grouped`)."""
    return exact_quantiles_grouped(df, group_by, column, [p], kind, [alias or f"{kind}_{column}"], small, k)
