"""Numbering rows within groups without a window over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roughcut.session import stored


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, *name: str,
             few: bool = False) -> DataFrame:
    """``df`` with ``out``, the number of each row from 0 within its ``group`` in the order of
    the columns ``order`` (nulls first).

    Rows that agree in ``group`` and ``order`` must be interchangeable. They, and the rows of
    one group, are spread over the tasks: the rows are sorted once by range, stored below
    ``name`` with their place, and what lies before a group in earlier parts is added from a
    table of one row per group and part. No window or task holds a group.

    ``few``: there are few groups (by the kind of ``group``, whatever the rows), so that table,
    which has at most as many rows as there are parts and groups, goes to every task, and the
    rows are not shuffled again to meet it.
    """
    spread = [*group, *order, "__spread"]
    keyed = df.withColumn("__spread", F.xxhash64(F.monotonically_increasing_id()))
    at = stored(keyed.repartitionByRange(*spread).sortWithinPartitions(*spread).drop("__spread")
                .select("*", F.monotonically_increasing_id().alias("__at")), *name) \
        .withColumn("__part", F.shiftright("__at", 33))
    keys = [F.col(g).alias(f"__k{i}") for i, g in enumerate(group)]
    alike = [f"__k{i}" for i in range(len(group))]
    parts = at.groupBy(*keys, F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = W.partitionBy(*alike).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*alike, "__p", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    return at.join(F.broadcast(parts) if few else parts, same).withColumn(out, F.col("__at") + F.col("__shift")) \
        .drop(*alike, "__p", "__shift", "__at", "__part")
