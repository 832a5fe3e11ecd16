"""Heavy hitters: the frequent values of columns, and their skew, without shuffling every
distinct value (P7, R3).

``profile_skew`` counts every value of every column. On a key column that is as many
rows as the table has, through the network, to learn that no value is frequent. Here

1. a frequent-items summary per column is kept for each bucket of partitions and merged in two
   levels; it holds a bounded number of values, and every value with more than a known share of
   the rows is among them;
2. one more pass counts these candidates exactly (they are joined as a broadcast of bounded size, and
   only their counts are shuffled);
3. what is left is known by its number of rows, its number of values (HLL) and the largest
   count that a value can have without being a candidate, which bounds the Gini coefficient.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roughcut.operators.profile import SKEW_GINI
from roughcut.operators.sampling import q

#: Values that a summary tracks: those with over 0.17 % of the rows are surely found.
TRACKED = 3_000
_BUCKETS = 1024  # summaries of one column that meet in one task
_HLL_LG = 14
_HLL_SIGMAS = 5  # relative errors of the number of values that the bounds allow for


def undetected_share(tracked: int = TRACKED) -> float:
    """The largest share of the rows that a value can have without being found.

    The summary is a hash map of m slots, the power of two that holds ``tracked`` values at
    three quarters full; its counts are at most 3.5 / m of the rows off, and a value is
    listed if its count less that error exceeds the error.
    """
    return 7.0 / 2 ** math.ceil(math.log2(max(tracked, 1) / 0.75))


def _text(column: str) -> str:
    """A value as text that is never NULL: NULL is a value like any other."""
    return f"coalesce(concat('=', CAST({q(column)} AS STRING)), '')"


def heavy_hitters(df: DataFrame, columns: Sequence[str], min_share: float | None = None,
                  tracked: int = TRACKED) -> DataFrame:
    """Every value of ``columns`` that at least ``min_share`` of the rows have (by default, the
    least share that is surely found), with its exact count.

    One row per value: ``column_name, value`` (as text, NULL for NULL), ``count, share``. Complete
    and exact: a ``min_share`` below what ``tracked`` values can promise
    (:func:`undetected_share`) raises. Two passes over the columns. An empty table has none.
    """
    least = undetected_share(tracked) if min_share is None else min_share
    if least < undetected_share(tracked):
        raise ValueError(f"{tracked} tracked values find shares over {undetected_share(tracked):.4%} only")
    facts = _summaries(df, columns, tracked, False)
    return _recounted(df, columns, facts, least)


def _summaries(df: DataFrame, columns: Sequence[str], tracked: int, distinct: bool) -> DataFrame:
    """One row (none of an empty table): ``n``, and per column i the candidates ``c<i>`` (and the number of values ``d<i>``)."""
    if not columns:
        raise ValueError("name the columns")
    part = [f"approx_top_k_accumulate({_text(c)}, {tracked}) AS s{i}" for i, c in enumerate(columns)]
    whole = [f"transform(approx_top_k_estimate(approx_top_k_combine(s{i}, {tracked}), {tracked}), x -> x.item) AS c{i}"
             for i in range(len(columns))]
    if distinct:
        part += [f"hll_sketch_agg({_text(c)}, {_HLL_LG}) AS h{i}" for i, c in enumerate(columns)]
        whole += [f"hll_sketch_estimate(hll_union_agg(h{i})) AS d{i}" for i in range(len(columns))]
    buckets = df.groupBy((F.spark_partition_id() % _BUCKETS).alias("__bucket")).agg(F.expr("count(1) AS n"), *map(F.expr, part))
    # by a constant: an empty table has no group, so that no summary of nothing is merged
    return buckets.groupBy(F.lit(0).alias("__all")).agg(F.sum("n").alias("n"), *map(F.expr, whole)).drop("__all")


def _recounted(df: DataFrame, columns: Sequence[str], facts: DataFrame, least: float) -> DataFrame:
    wanted = facts.select("n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("vs"))
                                                  for i in range(len(columns))])).alias("s")) \
        .select("n", F.col("s.i").alias("__i"), F.explode("s.vs").alias("__v"))
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.expr(_text(c)).alias("v"))
                                         for i, c in enumerate(columns)])).alias("s")).select("s.i", "s.v")
    # at most `tracked` values a column, whatever the table's size
    hits = rows.join(F.broadcast(wanted), (F.col("i") == F.col("__i")) & (F.col("v") == F.col("__v")))
    counts = hits.groupBy("i", "v").agg(F.count("*").alias("count"), F.first("n").alias("__n"))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.where(F.col("count") >= F.col("__n") * F.lit(least)).select(
        F.get(names, F.col("i")).alias("column_name"), F.when(F.col("v") != "", F.expr("substr(v, 2)")).alias("value"),
        "count", (F.col("count") / F.col("__n")).alias("share"))


def skew_bounds(df: DataFrame, columns: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """An interval that holds the normalised frequency Gini of each column, from its heavy
    hitters: one row per column with ``groups`` (estimated), ``heavy`` (values counted exactly),
    ``heavy_share``, ``gini_low``, ``gini_high``.

    Heads are all values above the share that is surely found. The others have R rows and D
    values (HLL, plus or minus five relative errors), each at least 1 row and at most that share:
    the Gini is least where they are even and greatest where as many as possible are full and
    the others single. Where every value is a head, both ends are the exact Gini. A column of
    one value has 0; an empty table gives no row.
    """
    columns = list(columns)
    # the summaries in one row, then the heads' counts: facts of bounded size, read by the driver
    facts = _summaries(df, columns, tracked, True)
    row = facts.first()
    spark = df.sparkSession
    schema = "column_name string, groups long, heavy long, heavy_share double, gini_low double, gini_high double"
    if row is None:
        return spark.createDataFrame([], schema)
    known = spark.createDataFrame([row], facts.schema)
    heads: dict[str, list[int]] = {c: [] for c in columns}
    for r in _recounted(df, columns, known, 0.0).select("column_name", "count").collect():  # at most `tracked` a column
        heads[r["column_name"]].append(r["count"])
    out = []
    for i, c in enumerate(columns):
        values = float(row[f"d{i}"])
        head, low, high = _gini_interval(row["n"], values, sorted(heads[c]), undetected_share(tracked) * row["n"])
        groups = len(head) if sum(head) == row["n"] else int(values)
        out.append((c, groups, len(head), sum(head) / row["n"], low, high))
    return spark.createDataFrame(out, schema)


def _gini_interval(rows: int, values: float, counts: list[int], most: float) -> tuple[list[int], float, float]:
    """The counts that are heads, and the least and greatest normalised Gini that fit."""
    if sum(counts) == rows:  # every value was counted
        return counts, *(2 * [_gini([(1.0, float(x)) for x in counts])])
    most = max(1.0, most)
    head = [x for x in counts if x > most]
    rest = rows - sum(head)
    if rest == 0:
        return head, *(2 * [_gini([(1.0, float(x)) for x in head])])
    off = _HLL_SIGMAS * 1.04 / math.sqrt(2 ** _HLL_LG)
    fewest = max(rest / most, values * (1 - off) - len(head), len(counts) - len(head), 1.0)
    greatest = max(min(float(rest), values * (1 + off) - len(head)), fewest)
    # the even rest: the Gini itself grows with the number of values, its normalisation falls with it
    low = _gini([(fewest, rest / fewest), *[(1.0, float(x)) for x in head]], norm=greatest + len(head))

    def uneven(x: float) -> float:
        full = (rest - x) / (most - 1) if most > 1 else 0.0
        full = min(max(full, 0.0), x)
        return _gini([(x - full, 1.0), (full, most), *[(1.0, float(y)) for y in head]], norm=fewest + len(head))
    # the sum of all differences, a x^2 + b x + c, over the number of values has one inner extreme
    at = [fewest, greatest]
    if greatest > fewest and most > 1:
        h, singles, fulls = len(head), sum(head) - len(head), sum(head) - most * len(head)
        a = -most / (most - 1)
        b = (rest * (most + 1) + most * singles - fulls) / (most - 1)
        c = rest * (fulls - singles - rest) / (most - 1) + _pairs(head)
        square = h * h - (b * h - c) / a
        if square > 0:
            at.append(min(max(-h + math.sqrt(square), fewest), greatest))
    return head, min(low, 1.0), min(max(map(uneven, at)), 1.0)


def _pairs(counts: list[int]) -> float:
    """The sum of the differences of all pairs of sorted counts."""
    return float(sum((2 * i - len(counts) + 1) * x for i, x in enumerate(counts)))


def _gini(levels: list[tuple[float, float]], norm: float | None = None) -> float:
    """Normalised Gini of (number of groups, count) in rising order of count; ``norm`` is
    the number of groups that the normalisation uses."""
    n = sum(m for m, _ in levels)
    total = sum(m * x for m, x in levels)
    if n <= 1 or total == 0:
        return 0.0
    area = below = 0.0
    for m, x in levels:  # under the Lorenz curve
        area += m / n * (below + m * x / total / 2)
        below += m * x / total
    k = n if norm is None else norm
    return max(1 - 2 * area, 0.0) * k / (k - 1) if k > 1 else 0.0


def is_skewed(df: DataFrame, column: str, limit: float = SKEW_GINI, tracked: int = TRACKED) -> bool | None:
    """Whether the column's normalised frequency Gini exceeds ``limit``; None where the
    interval of :func:`skew_bounds` holds the limit, so that only an exact count can tell."""
    r = skew_bounds(df, [column], tracked).first()
    if r is None or r["gini_high"] <= limit:
        return False
    return True if r["gini_low"] > limit else None
