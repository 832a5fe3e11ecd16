"""Distinct counts of combined conditions from stored theta sketches.

An HLL can be united, not intersected: "users of a but not of b" needs the table again. A
theta sketch of the keys per value of an attribute answers every AND, OR and NOT of such
values later, without a scan. Sets are written as ``is_in("kind", "a") - is_in("kind", "b")``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.operators.sketches import tree_aggregate

LG_K = 12  # 4,096 keys kept per sketch: about 1.6 % of a union's size


@dataclass(frozen=True)
class KeySet:
    """A set of keys: one attribute value, or two sets combined by ``&``, ``|`` or ``-``."""

    op: str
    parts: tuple

    def __and__(self, other: KeySet) -> KeySet:
        return KeySet("and", (self, other))

    def __or__(self, other: KeySet) -> KeySet:
        return KeySet("or", (self, other))

    def __sub__(self, other: KeySet) -> KeySet:
        return KeySet("not", (self, other))

    def values(self) -> list[tuple[str, str | None]]:
        """The (attribute, value) pairs that the set speaks of, each once."""
        if self.op == "is":
            return [self.parts]
        return list(dict.fromkeys(v for p in self.parts for v in p.values()))


def is_in(attribute: str, value) -> KeySet:
    """Keys of the rows whose ``attribute`` is ``value`` (None: is NULL). Values are compared as
    the strings that Spark casts them to."""
    if isinstance(value, bool):
        value = str(value).lower()
    return KeySet("is", (attribute, None if value is None else str(value)))


def value_sketches(df: DataFrame, key: str, attributes: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """One theta sketch of the distinct ``key`` per value of each attribute: ``attribute``,
    ``value`` (string), ``lg_k``, ``sketch``. Rows without a key count nowhere. Write it to keep it.

    Sketches merge in two levels, so a value that holds most rows is no single task's work;
    what shuffles is one sketch per value and task. Meant for attributes of few values: the
    result has a row of up to ``8 * 2^lg_k`` bytes per value. Attributes are sketched in
    a narrow pass each (two columns of the table).
    """
    if not 4 <= lg_k <= 26:
        raise ValueError("lg_k must be in [4, 26]")
    out = []
    for a in attributes:
        rows = df.select(F.col(a).cast("string").alias("value"), F.col(key).alias("__key")).where("__key IS NOT NULL")
        sk = tree_aggregate(rows, ["value"], {"sketch": (F.theta_sketch_agg("__key", lg_k),
                                                         lambda c: F.theta_union_agg(c, lg_k))})
        out.append(sk.select(F.lit(a).alias("attribute"), "value", F.lit(lg_k).alias("lg_k"), "sketch"))
    return reduce(DataFrame.unionByName, out)


def merge_value_sketches(sketches: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """Unites tables of sketches (of days, of shards) into one per attribute and value."""
    return sketches.groupBy("attribute", "value").agg(F.lit(lg_k).alias("lg_k"),
                                                      F.theta_union_agg("sketch", lg_k).alias("sketch"))


def _sketch(s: KeySet, names: dict) -> Column:
    if s.op == "is":
        return F.col(names[s.parts])
    a, b = (_sketch(p, names) for p in s.parts)
    if s.op == "or":
        return F.theta_union(a, b, F.col("__lg"))
    return F.theta_intersection(a, b) if s.op == "and" else F.theta_difference(a, b)


def distinct_in(sketches: DataFrame, sets: dict[str, KeySet], confidence: float = 0.95, lg_k: int = LG_K) -> DataFrame:
    """Distinct keys of each named set, from the sketches alone: ``set_name``, ``distinct_keys``,
    ``ci_low``, ``ci_high``.

    A combined set is known from the keys below the least threshold of its parts, about one in
    ``u / 2^lg_k`` where u is the size of the union of all parts, so an estimate m has a variance
    of at most ``m (u / 2^lg_k - 1)``: a small intersection of large sets is relatively vague.
    Up to ``2^lg_k`` keys in the union the answer is exact. Where no kept key is in the set, the upper
    end is ``-ln((1 - confidence) / 2)`` thresholds. A value that never occurred is an empty set.

    Several sketches of one value (of days, unmerged) are united; ``lg_k`` is the size they are
    united at, and the least size of all counts for the interval.

    Only the rows of the values asked for are read; the result has a row per set.
    """
    wanted = list(dict.fromkeys(v for s in sets.values() for v in s.values()))
    names = {v: f"__s{i}" for i, v in enumerate(wanted)}
    match = {v: (F.col("attribute") == v[0]) & F.col("value").eqNullSafe(F.lit(v[1])) for v in wanted}
    rows = sketches.where(reduce(lambda a, b: a | b, match.values()))
    one = rows.agg(F.least(F.min("lg_k"), F.lit(lg_k)).alias("__lg"), *[
        F.theta_union_agg(F.when(match[v], F.col("sketch")), lg_k).alias(n) for v, n in names.items()])
    one = one.withColumn("__lg", F.coalesce("__lg", F.lit(lg_k)))
    answers = []
    for name, s in sets.items():
        union = reduce(lambda a, b: a | b, [KeySet("is", v) for v in s.values()])
        answers.append(F.struct(F.lit(name).alias("set_name"), F.theta_sketch_estimate(_sketch(s, names)).alias("m"),
                                F.theta_sketch_estimate(_sketch(union, names)).alias("u"), F.col("__lg").alias("lg")))
    z = bounds.z_value(confidence)
    none = -math.log((1 - confidence) / 2)
    rest = "greatest(u / power(2.0D, lg) - 1, 0.0D)"
    return one.select(F.explode(F.array(*answers)).alias("x")).select("x.*").selectExpr(
        "set_name", "coalesce(m, 0L) AS distinct_keys",
        f"coalesce(greatest(0.0D, m - {z}D * sqrt(m * {rest})), 0.0D) AS ci_low",
        f"coalesce(CASE WHEN m = 0 THEN {none!r}D * {rest} ELSE m + {z}D * sqrt(m * {rest}) END, 0.0D) AS ci_high")
