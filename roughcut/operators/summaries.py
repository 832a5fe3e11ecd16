"""Stored summaries of a table's files: exact where a file lies inside a range, sampled where it straddles.

A range filter on a table that is at least roughly ordered by a column splits its files in
three: those wholly inside the range are answered from stored counts and sums, those
outside are skipped, and only the files that straddle an end are opened. Where too many
straddle (an unordered table), a fixed number of them is drawn, and only their part of the
answer is an estimate.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.hashing import hash60
from roughcut.operators.aggspec import as_aggs
from roughcut.operators.sampling import q

MAX_FILES = 256


def file_summaries(spark: SparkSession, path: str, ranges: Sequence[str], measures: Sequence[str] = (),
                   group_by: Sequence[str] = ()) -> DataFrame:
    """A row per file of the Parquet table at ``path`` and group: ``file``, the group,
    ``rows``, ``least_<c>``, ``most_<c>``, ``nulls_<c>`` of each range column, ``n_<m>`` and
    ``sum_<m>`` of each measure. One pass over these columns; a task ships one row per file and
    group that it read. Write the result to keep it.

    NULL is a group. Files that hold no rows have no summary. NaN counts as the largest value,
    as Spark orders it. The summaries speak of the files that were there; build them again
    after the table changed.
    """
    cols = [F.count("*").alias("rows")]
    for c in ranges:
        cols += [F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{c}")]
    for m in measures:
        cols += [F.count(m).alias(f"n_{m}"), F.sum(F.col(m)).cast("double").alias(f"sum_{m}")]
    table = spark.read.parquet(path)
    return table.groupBy(F.col("_metadata.file_path").alias("file"), *group_by).agg(*cols)


def range_aggregate(spark: SparkSession, path: str, summaries: DataFrame, column: str, low=None, high=None,
                    aggs=("count(*)",), group_by: Sequence[str] = (), max_files: int = MAX_FILES,
                    confidence: float = 0.95) -> DataFrame:
    """COUNT, SUM and AVG of the rows with ``low <= column <= high`` (an end of None is open).

    ``summaries`` of the table at ``path`` must have ``column`` among its ranges, the aggregated columns
    among its measures, and the columns of ``group_by`` (all of them) as its groups. Up to
    ``max_files`` straddling files are read, and the answer is exact if that is all of
    them. Otherwise that many are drawn by a hash of their names, and with t the totals of n
    drawn of m files the rest is estimated by ``m * mean(t)`` with the variance
    ``m^2 (1 - n/m) s^2 / n``; averages are ratios of two totals. Their names (at most
    ``max_files``) are what the driver sees of the table's files.

    Per aggregate ``x``: ``x``, ``x_ci_low``, ``x_ci_high``, ``x_error_pct`` (NULL if one file of several
    was drawn, or of an average of nothing); then ``files_inside``, ``files_straddling``, ``files_read``.
    Groups of which neither a file inside nor a row read shows a match are missing.
    """
    aggs, g = as_aggs(aggs), list(group_by)
    if any(a.func not in ("count", "sum", "avg") for a in aggs):
        raise ValueError("file summaries answer count, sum and avg")
    if max_files < 1:
        raise ValueError("one file must be allowed at least")
    least, most = F.min(f"least_{column}"), F.max(f"most_{column}")
    inside, outside = F.sum(f"nulls_{column}") == 0, most.isNull()
    if low is not None:
        inside, outside = inside & (least >= F.lit(low)), outside | (most < F.lit(low))
    if high is not None:
        inside, outside = inside & (most <= F.lit(high)), outside | (least > F.lit(high))
    files = summaries.groupBy("file").agg(F.when(outside, "outside").when(inside, "inside").otherwise("straddling").alias("class"))
    counts = {r["class"]: r["n"] for r in files.groupBy("class").agg(F.count("*").alias("n")).collect()}
    m, n_inside = counts.get("straddling", 0), counts.get("inside", 0)
    drawn = [unquote(r.file) for r in files.where("class = 'straddling'")
             .orderBy(hash60("file"), "file").limit(max_files).select("file").collect()]
    n = len(drawn)

    zero = F.lit(0.0)
    parts = [f"{k}{i}" for i in range(len(aggs)) for k in ("c", "t", "cc", "tt", "ct")]

    def part(rows: DataFrame, exact: bool) -> DataFrame:
        """Totals (exact), or sums over files of totals and their products."""
        out = []
        for i in range(len(aggs)):
            c, t = F.col(f"__c{i}"), F.col(f"__t{i}")
            out += [F.sum(x).alias(f"{k}{i}") for k, x in (("c", c), ("t", t), ("cc", c * c), ("tt", t * t), ("ct", c * t))]
        total = rows.groupBy(*g).agg(F.count("*").alias("seen"), *out)
        return total.select(*g, *[F.col(p).alias("e" + p) if exact else zero.alias("e" + p) for p in parts if len(p) == 2],
                            *[zero.alias("s" + p) if exact else F.col(p).alias("s" + p) for p in parts])

    def of(a, stored: bool):
        if a.column == "*":
            count = F.sum("rows") if stored else F.count("*")
            return count, count
        if stored:
            return F.sum(f"n_{a.column}"), F.sum(F.coalesce(f"sum_{a.column}", zero))
        return F.count(a.column), F.coalesce(F.sum(a.column).cast("double"), zero)

    def columns(stored: bool):
        return [x.cast("double").alias(f"__{k}{i}") for i, a in enumerate(aggs) for k, x in zip("ct", of(a, stored))]

    whole = summaries.join(files.where("class = 'inside'").select("file"), "file", "left_semi")
    answer = part(whole.groupBy("file", *g).agg(*columns(True)), True)
    if drawn:
        rows = spark.read.option("basePath", path).parquet(*drawn)
        for end, op in ((low, ">="), (high, "<=")):
            if end is not None:
                rows = rows.where(F.col(column) >= F.lit(end) if op == ">=" else F.col(column) <= F.lit(end))
        if low is None and high is None:
            rows = rows.where(F.col(column).isNotNull())
        read = rows.groupBy(F.col("_metadata.file_path").alias("file"), *g).agg(*columns(False))
        answer = answer.unionByName(part(read, False))
    sums = [F.sum(c).alias(c) for c in answer.columns if c not in g]
    total = answer.groupBy(*g).agg(*sums) if g else answer.agg(*sums)

    z, up = bounds.z_value(confidence), (m / n if n else 0.0)
    out = [q(c) for c in g]
    for i, a in enumerate(aggs):
        e, s = {k: f"coalesce(e{k}{i}, 0.0D)" for k in "ct"}, {k: f"coalesce(s{k}{i}, 0.0D)" for k in ("c", "t", "cc", "tt", "ct")}
        est = {k: f"({e[k]} + {up!r}D * {s[k]})" for k in "ct"}
        value = est["c"] if a.func == "count" else est["t"] if a.func == "sum" else f"try_divide({est['t']}, {est['c']})"
        if n == m:
            margin = "0.0D"
        elif n < 2:
            margin = "CAST(NULL AS DOUBLE)"
        else:
            if a.func == "avg":
                first, square = f"({s['t']} - {value} * {s['c']})", f"({s['tt']} - 2 * {value} * {s['ct']} + {value} * {value} * {s['cc']})"
            else:
                k = "c" if a.func == "count" else "t"
                first, square = s[k], s[k + k]
            spread = f"greatest(({square} - {first} * {first} / {n}) / {n - 1}, 0.0D)"
            margin = f"{z}D * sqrt({m * m * (1 - n / m) / n!r}D * {spread})"
            if a.func == "avg":
                margin = f"try_divide({margin}, {est['c']})"
        if a.func == "sum":
            value = f"(CASE WHEN {est['c']} > 0 THEN {value} END)"
        out += [f"{value} AS {q(a.name)}", f"{value} - {margin} AS {q(a.name + '_ci_low')}",
                f"{value} + {margin} AS {q(a.name + '_ci_high')}",
                f"round(CASE WHEN {margin} = 0 AND {value} IS NOT NULL THEN 0.0D ELSE try_divide({margin}, abs({value})) * 100 END, 4) "
                f"AS {q(a.name + '_error_pct')}"]
    out += [f"{n_inside} AS files_inside", f"{m} AS files_straddling", f"{n} AS files_read"]
    return total.selectExpr(*out)
