"""Outlier index: the rows that a sample estimates worst are stored exactly (H2, E5).

A uniform sample of a heavy-tailed column owes most of its variance to a few extreme rows,
which it either misses or counts many times over. Here at most k rows, those farthest from
the centre of the others, are kept exactly beside a stored tier. An estimate is the exact part
plus the tier's other rows scaled up; its margin comes from the spread of the others alone.

Whether a row is in the index is a predicate on its value, ``|value - center| > cut``, so
the tier needs no join to leave those rows out, and the same rule applies to any tier of the
table. The centre is found in two passes: the farthest rows from the mean of all are left
out of a second mean, since the mean itself is pulled by what the index takes away.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.frames import with_scalars
from roughcut.functions.ranking import numbered
from roughcut.operators.aggspec import as_aggs
from roughcut.operators.sampling import q

_PARTS = 32  # of an octave of distances
_FAR = 1e300  # the distance of NaN, the infinities and all beyond it


class Cut(NamedTuple):
    """Rows farther than ``cut`` from ``center`` are outliers."""

    center: float
    cut: float


def _distance(value: str, center: float) -> Column:
    y = F.col(value).cast("double")
    far = F.abs(y - F.lit(center))
    return F.when(F.isnan(y) | (far > _FAR), F.lit(_FAR)).otherwise(far)


def is_outlier(value: str, at: Cut) -> Column:
    """Whether a row belongs to the index (never, where the value is NULL)."""
    return F.coalesce(_distance(value, at.center) > F.lit(at.cut), F.lit(False))


def _above(df: DataFrame, value: str, center: float, k: int) -> tuple[int, int | None, float | None]:
    """Rows in the parts of an octave of distance above the one that holds the (k+1)-th farthest row,
    that part (None: there are no more than k rows off the centre), and the mean of the rows below it."""
    y, far = F.col(value).cast("double"), _distance(value, center)
    part = F.when(far > 0, F.floor(F.log2(far) * _PARTS))
    per = df.where(F.col(value).isNotNull()).groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum(y).alias("t")).collect()
    per.sort(key=lambda r: float("-inf") if r["p"] is None else r["p"], reverse=True)  # a row per part that occurs
    above = 0
    for i, r in enumerate(per):
        if r["p"] is None:
            break
        if above + r["n"] > k:
            rest = sum(x["n"] for x in per[i + 1:])
            return above, r["p"], sum(x["t"] for x in per[i + 1:]) / rest if rest else None
        above += r["n"]
    return above, None, None


def outlier_cut(df: DataFrame, value: str, k: int) -> Cut:
    """The rule that makes at most ``k`` rows outliers: those farther from the centre than the
    (k+1)-th farthest row.

    Rows that tie with that one are all left to the sample, so the index never exceeds ``k`` rows
    however many values are equal. NULL is never an outlier; NaN and the infinities are the
    farthest of all. Without values, or with no more than ``k`` rows off the centre, the cut is 0.
    Takes three passes over the one column and one over the part of an octave that the cut is in.
    """
    if k < 1:
        raise ValueError("an index of one row at least")
    y = F.col(value).cast("double")
    center = df.select(F.avg(F.when(F.abs(y) < _FAR, y))).first()[0]
    if center is None:
        return Cut(0.0, 0.0)
    pulled = _above(df, value, center, k)[2]
    center = center if pulled is None else pulled
    above, part, _ = _above(df, value, center, k)
    if part is None:
        return Cut(center, 0.0)
    far = _distance(value, center)
    edge = df.where((far > 0) & (F.floor(F.log2(far) * _PARTS) == part)).select((-far).alias("__down"))
    ranked = numbered(edge, [], ["__down"], "__rank", "outliers", "edge")
    return Cut(center, -ranked.where(F.col("__rank") == k - above).first()["__down"])


def outlier_aggregate(index: DataFrame, rest: DataFrame, rest_rows: int, aggs, group_by: Sequence[str] = (),
                      where: Column | str | None = None, value: str | None = None, at: Cut | None = None,
                      confidence: float = 0.95) -> DataFrame:
    """COUNT, SUM and AVG from the rows of the index and a uniform sample ``rest`` of the
    ``rest_rows`` others.

    Per aggregate ``x``: ``x``, ``x_ci_low``, ``x_ci_high``, ``x_error_pct``; then ``index_rows`` and
    ``sample_rows`` (those that match). A total is the index's plus the sample's times
    ``rest_rows / n``, with the variance of ``y * matches`` over all n sampled rows, so that an unknown
    number of matches counts too; an average is the ratio of two such totals. Where no sampled
    row matches, the error is unknown (NULL) and, for COUNT and the SUM of the indexed ``value``,
    the interval ends at the most rows that can match (Wilson) times the farthest value that ``at``
    leaves outside the index. Groups without an indexed or sampled row are missing.
    """
    aggs, g = as_aggs(aggs), list(group_by)
    if any(a.func not in ("count", "sum", "avg") for a in aggs):
        raise ValueError("an outlier index answers count, sum and avg")
    cond = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    rows = index.where(cond).withColumn("__in", F.lit(True)).unionByName(
        rest.where(cond).withColumn("__in", F.lit(False)), allowMissingColumns=True)
    stats = ["count_if(__in) AS index_rows", "count_if(NOT __in) AS sample_rows"]
    for i, a in enumerate(aggs):
        there = "true" if a.column == "*" else f"{q(a.column)} IS NOT NULL"
        y = "1.0D" if a.func == "count" else f"CAST({q(a.column)} AS DOUBLE)"
        for name, e in (("t", y), ("c", "1.0D")):
            stats += [f"coalesce(sum({e}) FILTER (WHERE __in AND {there}), 0.0D) AS __x{name}{i}",
                      f"coalesce(sum({e}) FILTER (WHERE NOT __in AND {there}), 0.0D) AS __{name}{i}"]
        stats.append(f"coalesce(sum({y} * {y}) FILTER (WHERE NOT __in AND {there}), 0.0D) AS __yy{i}")
    stats = [F.expr(s) for s in stats]
    total = with_scalars(rows.groupBy(*g).agg(*stats) if g else rows.agg(*stats), rest.agg(F.count("*").alias("__n")))
    N, n, z, out = f"{int(rest_rows)}L", "nullif(__n, 0L)", f"{bounds.z_value(confidence)}D", [q(c) for c in g]
    scale = f"(CASE WHEN {N} = 0 THEN 0.0D ELSE try_divide({N}, {n}) END)"
    least = bounds.domain_count_interval_sql("0L", n, N, confidence)["ci_high"]

    def margin(squares: str, plain: str) -> str:
        """Of a total over the others, from the sums of the squares and of the values themselves."""
        spread = f"try_divide(greatest({squares} - try_divide({plain} * {plain}, {n}), 0.0D), {n} - 1)"
        return f"(CASE WHEN {N} = 0 OR {n} >= {N} THEN 0.0D ELSE {z} * {N} * sqrt({spread} / {n} * (1.0D - {n} / CAST({N} AS DOUBLE))) END)"

    for i, a in enumerate(aggs):
        none = f"(__c{i} = 0 AND {N} > 0 AND coalesce({n} < {N}, true))"
        est = f"(__xt{i} + __t{i} * {scale})"
        low = high = "CAST(NULL AS DOUBLE)"
        if a.func == "avg":
            count = f"(__xc{i} + __c{i} * {scale})"
            est = f"try_divide({est}, {count})"
            m = f"try_divide({margin(f'(__yy{i} - 2 * {est} * __t{i} + {est} * {est} * __c{i})', f'(__t{i} - {est} * __c{i})')}, {count})"
        else:
            m = margin(f"__yy{i}", f"__t{i}")
            if a.func == "count":
                low, high = est, f"{est} + {least}"
            elif at is not None and a.column == value:
                low = f"{est} + {least} * least({at.center - at.cut!r}D, 0.0D)"
                high = f"{est} + {least} * greatest({at.center + at.cut!r}D, 0.0D)"
        out += [f"{est} AS {q(a.name)}",
                f"CASE WHEN {none} THEN {low} ELSE {est} - {m} END AS {q(a.name + '_ci_low')}",
                f"CASE WHEN {none} THEN {high} ELSE {est} + {m} END AS {q(a.name + '_ci_high')}",
                f"CASE WHEN NOT {none} THEN round(try_divide({m}, abs({est})) * 100, 4) END AS {q(a.name + '_error_pct')}"]
    return total.selectExpr(*out, "index_rows", "sample_rows")
