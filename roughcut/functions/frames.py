"""Small DataFrame helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, *one_rows: DataFrame, prefix: str = "") -> DataFrame:
    """Attach the columns of one-row DataFrames to every row of ``df``.

    Each is planned as a scalar subquery (computed once, its value inlined),
    so no join - in particular no nested-loop or cartesian join - is
    involved, and several frames attach side by side, not nested.
    """
    cols = []
    for one in one_rows:
        if len(one.columns) == 1:
            cols.append(one.scalar().alias(prefix + one.columns[0]))
            continue
        s = one.select(F.struct(*[F.col(c) for c in one.columns]).alias("__s")).scalar()
        cols += [s.getField(c).alias(prefix + c) for c in one.columns]
    return df.select("*", *cols)


def join_on_groups(left: DataFrame, right: DataFrame, group_by: list[str],
                   how: str = "full_outer") -> DataFrame:
    """Join two one-row-per-group results on the group key, null-safely.

    NULL is a group like any other, and the key columns come out once
    (coalesced from both sides). Both sides often descend from the same
    scan, so the keys are renamed on each side first; without group
    columns the right side's single row is attached as scalars.
    """
    if not group_by:
        return with_scalars(left, right)
    l2 = left.select(*[F.col(g).alias(f"__l_{g}") for g in group_by],
                     *[c for c in left.columns if c not in group_by])
    r2 = right.select(*[F.col(g).alias(f"__r_{g}") for g in group_by],
                      *[c for c in right.columns if c not in group_by])
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"__l_{g}").eqNullSafe(F.col(f"__r_{g}")) for g in group_by])
    j = l2.join(r2, cond, how)
    keys = [F.coalesce(F.col(f"__l_{g}"), F.col(f"__r_{g}")).alias(g) for g in group_by]
    rest = [c for c in j.columns if not c.startswith(("__l_", "__r_"))]
    return j.select(*keys, *rest)
