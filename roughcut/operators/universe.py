"""Join-key samples: both sides of a join keep the rows of the same drawn keys (C4, E5).

Independent row samples of two tables at rate r join at rate r * r and break up the
keys. Here a key is drawn or not, by one hash, so the sampled sides join to a whole r-th
of the joined rows: every joined row of a drawn key. The keys are the clusters of the
estimate; a table in which few keys hold most of the total states a wide interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.hashing import hash60, threshold
from roughcut.operators.aggspec import as_aggs
from roughcut.operators.sampling import q


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def universe_sample(df: DataFrame, key: str | Sequence[str], rate: float, salt: str = "",
                    hash_method: str = "md5", h: str | None = None) -> DataFrame:
    """The rows of ``df`` whose key is drawn at ``rate``. Other tables sampled with the same
    rate, salt and method by keys of equal values (and types, for ``xxhash``) keep the same
    keys. ``h`` names a stored hash of the key, which the reader can prune by."""
    if h is not None:
        return df.where(F.col(h) < threshold(rate))
    if salt:
        df = df.withColumn("__salt", F.lit(salt))
    kept = df.where(hash60([*(["__salt"] if salt else []), *_names(key)], hash_method) < threshold(rate))
    return kept.drop("__salt")


def universe_join_aggregate(left: DataFrame, right: DataFrame, left_key: str | Sequence[str],
                            right_key: str | Sequence[str], rate: float, aggs, group_by: Sequence[str] = (),
                            where: Column | str | None = None, salt: str = "", hash_method: str = "md5",
                            sampled: bool = False, confidence: float = 0.95) -> DataFrame:
    """COUNT, SUM and AVG over the inner join of two tables, from the keys drawn at ``rate``.

    With t the totals of the drawn keys, a total is ``sum(t) / rate`` with the variance
    ``(1 - rate) / rate^2 * sum(t^2)`` of keys drawn independently; an average is the ratio of
    two totals with the variance of its residuals. Keys of any number of rows on both sides are
    allowed, and NULL keys join nothing. ``where`` may speak of both tables' columns, whose
    names must differ. ``sampled=True`` says that both frames are such samples already.

    Both filters stand below the join, so only the drawn rows shuffle, and the totals by
    key need no shuffle beyond the join's. Per aggregate ``x``: ``x``, ``x_ci_low``, ``x_ci_high``,
    ``x_error_pct``; then ``sample_keys``. Groups that no drawn key leads to are missing.
    """
    aggs, g = as_aggs(aggs), list(group_by)
    if any(a.func not in ("count", "sum", "avg") for a in aggs):
        raise ValueError("join-key samples answer count, sum and avg")
    lk, rk = _names(left_key), _names(right_key)
    if not sampled:
        left = universe_sample(left, lk, rate, salt, hash_method)
        right = universe_sample(right, rk, rate, salt, hash_method)
    on = None
    for a, b in zip(lk, rk, strict=True):
        eq = left[a] == right[b]
        on = eq if on is None else on & eq
    rows = left.join(right, on)
    rows = rows if where is None else rows.where(where)
    per_key, sums = [], [F.count("*").alias("sample_keys")]
    for i, a in enumerate(aggs):
        y = F.lit(1) if a.column == "*" else F.col(a.column)
        n = F.count(y).cast("double")
        per_key += [n.alias(f"__n{i}"), (n if a.func == "count" else F.coalesce(F.sum(y), F.lit(0)).cast("double")).alias(f"__t{i}")]
        t, c = F.col(f"__t{i}"), F.col(f"__n{i}")
        sums += [F.sum(t).alias(f"__st{i}"), F.sum(c).alias(f"__sn{i}"), F.sum(t * t).alias(f"__tt{i}"),
                 F.sum(c * c).alias(f"__nn{i}"), F.sum(t * c).alias(f"__tn{i}")]
    keys = rows.groupBy(*[left[c].alias(f"__k{i}") for i, c in enumerate(lk)], *g).agg(*per_key)
    total = keys.groupBy(*g).agg(*sums) if g else keys.agg(*sums)
    z, out = bounds.z_value(confidence), [q(c) for c in g]
    rest = (1.0 - rate) / (rate * rate)
    for i, a in enumerate(aggs):
        st, sn, tt, nn, tn = (f"coalesce(__{k}{i}, 0.0D)" for k in ("st", "sn", "tt", "nn", "tn"))
        if a.func == "avg":
            est = f"try_divide({st}, {sn})"
            ss = f"greatest({tt} - 2 * {est} * {tn} + {est} * {est} * {nn}, 0.0D)"
            margin = f"{z}D * try_divide(sqrt({bounds.sql(rest)} * {ss}), {sn} / {bounds.sql(rate)})"
        else:
            est, margin = f"{st} / {bounds.sql(rate)}", f"{z}D * sqrt({bounds.sql(rest)} * {tt})"
        out += [f"{est} AS {q(a.name)}", f"{est} - {margin} AS {q(a.name + '_ci_low')}",
                f"{est} + {margin} AS {q(a.name + '_ci_high')}",
                f"round(try_divide({margin}, abs({est})) * 100, 4) AS {q(a.name + '_error_pct')}"]
    return total.selectExpr(*out, "sample_keys")
