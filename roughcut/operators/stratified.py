"""Stratified sampling with a per-stratum guarantee (inventory S1-S9).

Every stratum (distinct value of the group columns) is sampled at the same
rate with the deterministic row hash ``h``; a stratum that no hash falls
below the threshold keeps its single minimum-hash row, so every stratum is
represented. Estimates use the realised rate ``n_g / N_g`` per stratum.

Plans, and why they hold at scale:

* :func:`strata_table` is one hash aggregate with map-side partial
  aggregation: a stratum holding a third of all rows still shuffles one
  partial row per partition.
* :func:`stratified_aggregate` answers COUNT/SUM/AVG/MIN/MAX per stratum in
  the **same single pass** as the population counts: the sampled values are
  conditional aggregates, and the forced minimum-hash row comes from
  ``min_by(value, h)``. No join, no second scan.
* :func:`stratified_sample` filters the base rows by the hash threshold and
  adds one minimum-hash row for every stratum left empty. The empty strata
  (key and ``min_h``, from the numeric strata aggregate) are broadcast once
  their measured size is under ``broadcast_bytes``; the base rows are then
  only filtered, and rows that tie for a stratum are reduced to one map-side.
  Beyond that bound each empty stratum's row is carried out of an aggregate
  as ``min_by(struct(row), h)`` instead: still no shuffle of base rows, at
  the price of a sort-based aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from roughcut.functions import bounds
from roughcut.functions.hashing import HASH_SPACE, threshold, with_row_hash
from roughcut.operators.aggspec import Agg, as_aggs
from roughcut.operators.sampling import q
from roughcut.session import ensure_checkpoint_dir


def _hash_sql(h: str) -> str:
    """The row hash; a NULL in a stored hash column counts as the largest, so that the row
    still belongs to the whole (rate 1) and can represent its stratum."""
    return f"coalesce({q(h)}, {bounds.sql(HASH_SPACE - 1)})"


def _groups(group_by: str | Sequence[str]) -> list[str]:
    return [group_by] if isinstance(group_by, str) else list(group_by)


def strata_distinct(df: DataFrame, group_by) -> DataFrame:
    """The strata (distinct group values)."""
    return df.select(*_groups(group_by)).distinct()


def strata_table(df: DataFrame, group_by, rate: float, key=None, h: str = "h",
                 with_rows: bool = False, hash_method: str = "md5", extremes: bool = False) -> DataFrame:
    """S3: per stratum ``population_count``, ``below_count`` (rows under the
    rate threshold), ``sample_count`` (= max(below_count, 1)) and ``min_h``.

    ``with_rows=True`` adds ``forced_row``: the whole minimum-hash row of the
    stratum (a struct), which is the stratum's sample when no hash falls
    under the threshold. ``extremes=True`` adds ``min__x`` and ``max__x`` of every
    numeric column x (DOUBLE), which bound a SUM of rows that the sample missed.
    """
    g = _groups(group_by)
    if h not in df.columns:
        df = with_row_hash(df, key, h, hash_method)
    hash_ = F.expr(_hash_sql(h))
    below = hash_ < F.lit(threshold(rate))
    aggs = [F.count(F.lit(1)).alias("population_count"),
            F.count_if(below).alias("below_count"),
            F.min(hash_).alias("min_h")]
    if extremes:
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in (h, *g)]
        aggs += [fn(F.col(q(c))).cast("double").alias(f"{fn.__name__}__{c}") for c in numeric for fn in (F.min, F.max)]
    if with_rows:
        aggs.append(F.min_by(F.struct(*[F.col(c) for c in df.columns]), hash_).alias("forced_row"))
    return (df.groupBy(*g).agg(*aggs)
            .withColumn("sample_count", F.greatest(F.col("below_count"), F.lit(1)).cast("bigint")))


DEFAULT_BROADCAST_BYTES = 32 << 20  # of empty strata, keys and hashes


def stratified_sample(df: DataFrame, group_by, rate: float, key=None, h: str = "h",
                      strata: DataFrame | None = None, hash_method: str = "md5",
                      broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Sample rows, ``rate`` per stratum, at least one row per stratum.

    ``strata`` may be a stored strata table (see :func:`strata_table`);
    otherwise it is computed and checkpointed to the shared checkpoint
    folder, which cuts its lineage before it is counted and joined. When
    several rows share the smallest hash of an empty stratum (rows of one key,
    or without a key), one of them represents it.
    """
    g = _groups(group_by)
    if h not in df.columns:
        df = with_row_hash(df, key, h, hash_method)
    thr = F.lit(threshold(rate))
    if strata is None:
        ensure_checkpoint_dir(df.sparkSession)
        strata = strata_table(df, g, rate, h=h).checkpoint(eager=True)
    empty = strata.filter(F.col("below_count") == 0)
    hash_ = F.expr(_hash_sql(h))
    width = F.lit(32) + sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in g), F.lit(0))
    n_empty, size = empty.agg(F.count(F.lit(1)), F.sum(width)).first()
    if n_empty == 0:
        return df.filter(hash_ < thr)
    if size <= broadcast_bytes:
        e = F.broadcast(empty.select(*[F.col(c).alias(f"__e_{c}") for c in g],
                                     F.col("min_h").alias("__e_h")))
        cond = hash_ == F.col("__e_h")
        for c in g:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__e_{c}"))
        forced = df.join(e, cond).select(*df.columns).dropDuplicates(g)
        return df.filter(hash_ < thr).unionByName(forced)
    forced = (strata_table(df, g, rate, h=h, with_rows=True)
              .filter(F.col("below_count") == 0).select("forced_row.*"))
    return df.filter(hash_ < thr).unionByName(forced.select(*df.columns))


def _sampled(a: Agg, sel: str, w: str, h: str) -> list[str]:
    """SQL text of one aggregate's sample value: ``__b`` over the rows under
    the threshold, ``__f`` for the stratum's forced minimum-hash row
    (``min_by`` over the whole stratum), ``__sd`` their spread."""
    if a.func == "count":
        cond = sel if a.column == "*" else f"{sel} AND {q(a.column)} IS NOT NULL"
        forced_ok = w if a.column == "*" else f"{w} AND {q(a.column)} IS NOT NULL"
        return [f"count_if({cond}) AS {q(a.name + '__b')}",
                f"CAST(min_by(CASE WHEN {forced_ok} THEN 1 ELSE 0 END, {h}) AS BIGINT) AS {q(a.name + '__f')}"]
    c = q(a.column)
    picked = f"CASE WHEN {sel} THEN {c} END"
    forced = f"CAST(min_by(CASE WHEN {w} THEN {c} END, {h}) AS DOUBLE) AS {q(a.name + '__f')}"
    if a.func == "sum":
        out = [f"CAST(sum({picked}) AS DOUBLE) AS {q(a.name + '__b')}", forced]
    elif a.func == "avg":
        out = [f"CAST(sum({picked}) AS DOUBLE) / count({picked}) AS {q(a.name + '__b')}", forced]
    else:
        out = [f"CAST({a.func}({picked}) AS DOUBLE) AS {q(a.name + '__b')}", forced]
    if a.func in ("sum", "avg"):
        # spread and number of the sampled values (a lone forced row has no spread)
        out += [f"stddev_samp({picked}) AS {q(a.name + '__sd')}", f"count({picked}) AS {q(a.name + '__k')}",
                f"CAST(min_by(CASE WHEN {w} THEN {c} END, {h}) IS NOT NULL AS BIGINT) AS {q(a.name + '__fk')}"]
    if a.func == "sum":
        # the pass sees every row, so the extremes of the stratum are known
        out += [f"CAST(min({c}) AS DOUBLE) AS {q(a.name + '__lo')}", f"CAST(max({c}) AS DOUBLE) AS {q(a.name + '__hi')}"]
    return out


def count_interval(a: Agg, hits: str, n: str, N: str, filtered: bool) -> list[str]:
    """``x_error_pct``, ``x_ci_low`` and ``x_ci_high`` of a stratum COUNT: without a filter
    a COUNT(*) is the known size of the stratum, anything else is a share of it."""
    if filtered or a.column != "*":
        b = bounds.domain_count_interval_sql(hits, n, N)
    else:
        exact = f"CAST({hits} * {N} / {n} AS BIGINT)"
        b = {"error_pct": "0.0D", "ci_low": exact, "ci_high": exact}
    return [f"{b[k]} AS {q(a.name + '_' + k)}" for k in ("error_pct", "ci_low", "ci_high")]


def stratified_aggregate(df: DataFrame, group_by, aggs, rate: float, key=None,
                         where: Column | str | None = None, h: str = "h",
                         hash_method: str = "md5") -> DataFrame:
    """Per-stratum estimates from the guaranteed stratified sample.

    Output: group columns, one column per aggregate (COUNT and SUM scaled by
    ``N_g / n_g`` of the **unfiltered** stratum, AVG/MIN/MAX as sampled),
    ``x_sample`` for COUNT/SUM, ``x_ci_low``/``x_ci_high`` for COUNT (exact
    without a filter, Wilson's interval with one), SUM (normal interval from
    the spread within the stratum of the value times whether the row matches,
    rows that do not match counting as 0) and AVG (a ratio: from the spread of
    the sampled values that match), both with finite-population correction
    and NULL when fewer than two rows were sampled, ``x_error_pct`` per COUNT/SUM/AVG (relative margin of that
    estimate), ``sample_count``, ``population_count`` and the reference's
    per-stratum ``error_pct``. With ``where`` every stratum stays in the
    result: one without a matching sampled row has COUNT and SUM 0 with an
    unknown relative error, and bounds, since unsampled rows may match: of the
    COUNT Wilson's, of the SUM that many rows of the stratum's largest value.
    """
    g = _groups(group_by)
    aggs = as_aggs(aggs)
    if h not in df.columns:
        df = with_row_hash(df, key, h, hash_method)
    w = "true"
    if where is not None:
        # the predicate becomes a named boolean column so the text can refer to it
        df = df.withColumn("__w", where if isinstance(where, Column) else F.expr(where))
        w = "__w"
    hq = _hash_sql(h)
    below = f"{hq} < {bounds.sql(threshold(rate))}"
    sel = f"({below}) AND {w}"
    stats = ["count(1) AS population_count", f"count_if({below}) AS below_count"]
    for a in aggs:
        stats += _sampled(a, sel, w, hq)
    agg = df.groupBy(*g).agg(*[F.expr(x) for x in stats])

    has_below = "below_count > 0"
    n = "greatest(below_count, 1)"
    N = "population_count"
    out = [q(c) for c in g]
    for a in aggs:
        # sampled values of the (filtered) domain, and their number in the stratum as estimated
        k = f"(CASE WHEN {has_below} THEN {q(a.name + '__k')} ELSE {q(a.name + '__fk')} END)"
        N_k = f"({k} * {N} / {n})"
        v = f"(CASE WHEN {has_below} THEN {q(a.name + '__b')} ELSE {q(a.name + '__f')} END)"
        name = q(a.name)
        if a.func == "count":
            out += [f"CAST(floor({v} * {N} / {n}) AS BIGINT) AS {name}", f"{v} AS {q(a.name + '_sample')}"]
            out += count_interval(a, v, n, N, where is not None)
        elif a.func == "sum":
            if where is not None:
                v = f"coalesce({v}, 0.0D)"
            b = bounds.domain_sum_sql(v, q(a.name + "__sd"), k, n, N, q(a.name + "__lo"), q(a.name + "__hi"))
            out += [f"{v} * {N} / {n} AS {name}", f"{v} AS {q(a.name + '_sample')}",
                    f"{b['ci_low']} AS {q(a.name + '_ci_low')}", f"{b['ci_high']} AS {q(a.name + '_ci_high')}",
                    f"{b['error_pct']} AS {q(a.name + '_error_pct')}"]
        elif a.func == "avg":
            m = bounds.avg_bound_sql(q(a.name + "__sd"), k, N_k)["margin"]
            out += [f"{v} AS {name}", f"round({v} - {m}, 4) AS {q(a.name + '_ci_low')}",
                    f"round({v} + {m}, 4) AS {q(a.name + '_ci_high')}",
                    f"CASE WHEN {v} != 0 THEN round({m} / abs({v}) * 100, 2) END AS {q(a.name + '_error_pct')}"]
        else:
            out.append(f"{v} AS {name}")
    out += [f"CAST({n} AS BIGINT) AS sample_count", f"{N} AS population_count",
            f"{bounds.stratum_error_pct_sql(n, N)} AS error_pct"]
    return agg.selectExpr(*out)
