"""Materialized samples in accuracy tiers (inventory E1-E9).

Layout under the store root (a folder in the shared checkpoint location)::

    <root>/<table>/tiers/v<id>/data/tier_ppm=10000/...   rows with h < thr(1 %)
    <root>/<table>/tiers/v<id>/data/tier_ppm=100000/...  thr(1 %) <= h < thr(10 %)
    <root>/<table>/tiers/v<id>/data/tier_ppm=200000/...  thr(10 %) <= h < thr(20 %)
    <root>/<table>/tiers/meta/v<id>                      one row per tier
    <root>/<table>/strat__<cols>/v<id>/data              stratified sample rows
    <root>/<table>/strat__<cols>/v<id>/strata            N_g, n_g, min_h per stratum
    <root>/<table>/strat__<cols>/meta/v<id>              one row
    <root>/<table>/priority__<weight>/v<id>/data         k rows by weight, with inclusion
    <root>/<table>/universe__<key>/v<id>/data            rows of the drawn join keys
    <root>/<table>/outliers__<value>/v<id>/data          the extreme rows, exact beside the tiers

Every build writes a new version and adds its metadata row last, so readers
always see the newest *complete* build: a build or refresh that dies part
way leaves the previous version in place (an in-place overwrite would
have deleted it first). :meth:`SampleStore.vacuum` removes superseded
versions; :meth:`SampleStore.refresh` does so after it succeeds.

Because the hash tiers nest, all tiers are written in **one** scan and
stored once: the storage overhead is the largest rate (20 %), not the sum
of the rates. Reading tier r is ``tier_ppm <= r`` on the partition column,
so Spark prunes the other directories and reads exactly r of the rows.
The stored ``h`` column lets a caller draw any smaller sub-sample from a
tier with a plain (and row-group-prunable) filter.
"""

from __future__ import annotations

import datetime as _dt
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roughcut.functions.hashing import hash60, threshold, with_row_hash
from roughcut.operators import sampling, stratified
from roughcut.operators.aggspec import as_aggs
from roughcut.operators.outliers import Cut, is_outlier, outlier_aggregate, outlier_cut
from roughcut.operators.priority import priority_sample
from roughcut.operators.profile import invalidate_profile
from roughcut.operators.universe import universe_join_aggregate
from roughcut.session import is_missing_path, shared_dir

# The default tiers of the reference (1 %, 10 %, 20 %)
DEFAULT_TIERS = (0.01, 0.10, 0.20)

META_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("sample_type", T.StringType()),
    T.StructField("rate", T.DoubleType()),
    T.StructField("group_cols", T.StringType()),
    T.StructField("sample_rows", T.LongType()),
    T.StructField("population_rows", T.LongType()),
    T.StructField("stored_rows", T.LongType()),
    T.StructField("key_cols", T.StringType()),
    T.StructField("built_at", T.TimestampType()),
    T.StructField("hash_method", T.StringType()),
    T.StructField("data_path", T.StringType()),
    # the columns as they are, whatever characters their names hold
    T.StructField("group_list", T.ArrayType(T.StringType())),
    T.StructField("key_list", T.ArrayType(T.StringType())),
    # group columns whose values a tier build stored
    T.StructField("known_groups", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("weight", T.StringType()),  # of a priority sample; the value of an outlier index
    # the folders that hold the rows, where they are several (see operators/upkeep.py)
    T.StructField("parts", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),  # the files that a sample follows
    T.StructField("center", T.DoubleType()),  # rows farther than ``cut`` from it are in the outlier index
    T.StructField("cut", T.DoubleType()),
    T.StructField("budget", T.LongType()),  # rows that the index may hold
])
OTHER_KINDS = ("stratified", "priority", "universe", "outliers")  # sample types that are not tiers


def meta_row(**known) -> tuple:
    """A metadata row with the given fields, the others NULL."""
    return tuple(known.pop(f.name, None) for f in META_SCHEMA.fields)


def now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


def _version() -> str:
    """A sortable, unique build id."""
    return f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def ppm(rate: float) -> int:
    return int(round(rate * 1_000_000))


def tier_name(rate: float) -> str:
    pct = rate * 100
    return f"{int(pct)}pct" if float(pct).is_integer() else f"{pct:g}pct".replace(".", "_")


class SampleStore:
    """Stored samples of one or more tables, kept as Parquet datasets."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        """``root`` defaults to a stable folder under ``spark.checkpoint.dir``,
        so samples built once are found by later sessions."""
        self.spark = spark
        self.root = (root or shared_dir(spark, "samples", per_app=False)).rstrip("/")
        # driver-side handles: registry rows (a few per sample) and dataset
        # readers (their file listing); dropped whenever a sample is rebuilt
        self._meta_rows: list | None = None
        self._frames: dict[str, DataFrame] = {}
        self.decisions: dict[tuple, object] = {}  # plans of requests already checked against their target

    def _invalidate(self) -> None:
        self._meta_rows = None
        self._frames.clear()
        self.decisions.clear()

    def _read(self, path: str) -> DataFrame:
        if path not in self._frames:
            self._frames[path] = self.spark.read.parquet(path)
        return self._frames[path]

    # ---------------------------------------------------------------- paths
    def _tiers(self, table: str) -> str:
        return f"{self.root}/{table}/tiers"

    def _strat(self, table: str, group_by: Sequence[str]) -> str:
        return f"{self.root}/{table}/strat__{'__'.join(group_by)}"

    # ---------------------------------------------------------------- build
    def build_tiers(self, df: DataFrame, table: str, key, rates=DEFAULT_TIERS,
                    hash_method: str = "md5", known_groups: Sequence[Sequence[str]] = ()) -> DataFrame:
        """All uniform tiers in one write; returns the new meta rows.

        A stored ``h`` column on ``df`` is used as is; otherwise the key is
        hashed (``hash_method="xxhash"`` is the cheap choice when no SQL twin
        of the sample is needed).

        ``known_groups`` names group columns whose distinct values (with their
        number of rows) are stored with the tiers. With them a grouped answer from a
        tier has every group, those without a sampled row too; without them the
        planner takes no grouped answer from a tier.
        """
        rates = sorted(set(float(r) for r in rates))
        key = [key] if isinstance(key, str) else list(key)
        self._invalidate()
        dfh = with_row_hash(df, key, method=hash_method)
        h = F.col("h")
        band = None
        for r in rates:
            band = (F.when(h < threshold(r), F.lit(ppm(r))) if band is None
                    else band.when(h < threshold(r), F.lit(ppm(r))))
        base, ver = self._tiers(table), _version()
        data = f"{base}/{ver}/data"
        # REBALANCE lets AQE cut each band into advisory-size files (instead
        # of one small file per band from every scan task), and sorting by h
        # inside the files makes any sub-sample of a tier row-group-prunable.
        seen = Observation()
        (dfh.observe(seen, F.count(F.lit(1)).alias("rows"))
            .filter(h < threshold(rates[-1])).withColumn("tier_ppm", band)
            .hint("rebalance", "tier_ppm").sortWithinPartitions("h")
            .write.partitionBy("tier_ppm").parquet(data))
        # The population is counted in the pass that writes, so n and N belong
        # to the same rows even when the input moves; the tier sizes are a
        # count over the written rows grouped by partition value.
        population = seen.get["rows"]
        per_band = dict(self.spark.read.parquet(data).groupBy("tier_ppm").count()
                        .select("tier_ppm", "count").collect())
        cum = [sum(per_band.get(ppm(x), 0) for x in rates if x <= r) for r in rates]
        known = [list(g) for g in known_groups]
        for i, g in enumerate(known):
            df.groupBy(*g).agg(F.count(F.lit(1)).alias("population_count")).write.parquet(f"{base}/{ver}/groups__{i}")
        built = now()
        rows = [meta_row(table_name=table, sample_type=tier_name(r), rate=r, sample_rows=cum[i], population_rows=population,
                         stored_rows=cum[-1], key_cols=",".join(key), key_list=key, built_at=built,
                         hash_method=hash_method, data_path=data, known_groups=known) for i, r in enumerate(rates)]
        return self._publish(rows, f"{base}/meta/{ver}")

    def build_stratified(self, df: DataFrame, table: str, group_by, key,
                         rate: float = 0.10, hash_method: str = "md5") -> DataFrame:
        """Stratified sample (``rate`` per stratum, >= 1 row per stratum)."""
        g = [group_by] if isinstance(group_by, str) else list(group_by)
        key = [key] if isinstance(key, str) else list(key)
        self._invalidate()
        dfh = with_row_hash(df, key, method=hash_method)
        base, ver = self._strat(table, g), _version()
        # the written strata table cuts the lineage; the sample is then one
        # scan joined to the (counted, broadcast) empty strata
        stratified.strata_table(dfh, g, rate, extremes=True).write.parquet(f"{base}/{ver}/strata")
        strata = self.spark.read.parquet(f"{base}/{ver}/strata")
        rows = stratified.stratified_sample(dfh, g, rate, strata=strata)
        rows.hint("rebalance").write.parquet(f"{base}/{ver}/data")
        sizes = strata.agg(F.sum("sample_count").alias("s"),
                           F.sum("population_count").alias("n")).first()
        return self._publish(
            [meta_row(table_name=table, sample_type="stratified", rate=float(rate), group_cols=",".join(g), group_list=g,
                      sample_rows=sizes["s"], population_rows=sizes["n"], stored_rows=sizes["s"], key_cols=",".join(key),
                      key_list=key, built_at=now(), hash_method=hash_method, data_path=f"{base}/{ver}/data")],
            f"{base}/meta/{ver}")

    def build_priority(self, df: DataFrame, table: str, k: int, weight: str, key, hash_method: str = "md5") -> DataFrame:
        """A weighted sample of exactly ``k`` rows (see :mod:`roughcut.operators.priority`)."""
        key = [key] if isinstance(key, str) else list(key)
        self._invalidate()
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        base, ver = f"{self.root}/{table}/priority__{weight}", _version()
        rows = priority_sample(df, k, weight, key, hash_method=hash_method)
        rows.hint("rebalance").write.parquet(f"{base}/{ver}/data")
        counted.select(F.lit(1)).write.format("noop").mode("overwrite").save()
        n = self.spark.read.parquet(f"{base}/{ver}/data").count()
        return self._publish(
            [meta_row(table_name=table, sample_type="priority", rate=n / max(seen.get["rows"], 1), sample_rows=n,
                      population_rows=seen.get["rows"], stored_rows=n, key_cols=",".join(key), key_list=key,
                      built_at=now(), hash_method=hash_method, data_path=f"{base}/{ver}/data", weight=weight)],
            f"{base}/meta/{ver}")

    def build_universe(self, df: DataFrame, table: str, key, rate: float, hash_method: str = "md5") -> DataFrame:
        """The rows of the keys drawn at ``rate``, for joins with other tables stored by
        keys of equal values (see :mod:`roughcut.operators.universe`); sorted by the key's hash, so
        a lower rate is a row-group-pruned read."""
        key = [key] if isinstance(key, str) else list(key)
        self._invalidate()
        base, ver = f"{self.root}/{table}/universe__{'__'.join(key)}", _version()
        seen = Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("rows")).withColumn("__key_hash", hash60(key, hash_method))
            .where(F.col("__key_hash") < threshold(rate)).hint("rebalance").sortWithinPartitions("__key_hash")
            .write.parquet(f"{base}/{ver}/data"))
        n = self.spark.read.parquet(f"{base}/{ver}/data").count()
        return self._publish(
            [meta_row(table_name=table, sample_type="universe", rate=float(rate), sample_rows=n,
                      population_rows=seen.get["rows"], stored_rows=n, key_cols=",".join(key), key_list=key,
                      built_at=now(), hash_method=hash_method, data_path=f"{base}/{ver}/data")],
            f"{base}/meta/{ver}")

    def build_outliers(self, df: DataFrame, table: str, value: str, k: int) -> DataFrame:
        """H2/E5: an index of the at most ``k`` rows whose ``value`` is farthest from the others',
        beside the table's tiers (see :mod:`roughcut.operators.outliers`)."""
        self._invalidate()
        base, ver = f"{self.root}/{table}/outliers__{value}", _version()
        at = outlier_cut(df, value, k)
        seen = Observation()
        (df.observe(seen, F.count(F.lit(1)).alias("rows")).where(is_outlier(value, at))
            .hint("rebalance").write.parquet(f"{base}/{ver}/data"))
        n = self.spark.read.parquet(f"{base}/{ver}/data").count()
        return self._publish(
            [meta_row(table_name=table, sample_type="outliers", rate=n / max(seen.get["rows"], 1), sample_rows=n,
                      population_rows=seen.get["rows"], stored_rows=n, built_at=now(), data_path=f"{base}/{ver}/data",
                      weight=value, center=at.center, cut=at.cut, budget=k)],
            f"{base}/meta/{ver}")

    def _publish(self, rows: list, meta_path: str) -> DataFrame:
        """Write a build's metadata - the last step, which makes it visible."""
        self.spark.createDataFrame(rows, META_SCHEMA).coalesce(1).write.parquet(meta_path)
        self._invalidate()
        return self.spark.read.parquet(meta_path)

    # ---------------------------------------------------------------- read
    def registry(self) -> DataFrame:
        """Every stored sample with its size and realised rate."""
        # the newest published build of a table's tiers, which replaces all tiers of older
        # ones, and of each stratified sample (a few rows per version; paths sort by build time)
        kind = F.when(F.col("sample_type").isin(*OTHER_KINDS), F.col("sample_type")).otherwise("tiers")
        by_key = F.when(kind == "universe", F.col("key_list"))
        build = Window.partitionBy("table_name", kind, "group_list", "weight", by_key)
        meta = (self._all_meta().withColumn("__newest", F.max("data_path").over(build))
                .filter(F.col("data_path") == F.col("__newest")).drop("__newest"))
        # storage_overhead: rows physically stored for this sample over the
        # population (all nested tiers share one dataset, so they report the
        # same overhead: the largest rate)
        return (meta.withColumn("group_list", F.coalesce("group_list", F.split("group_cols", ",")))
                .withColumn("key_list", F.coalesce("key_list", F.split("key_cols", ",")))
                .withColumn("realised_rate", F.col("sample_rows") / F.col("population_rows"))
                .withColumn("storage_overhead", F.col("stored_rows") / F.col("population_rows")))

    def _all_meta(self) -> DataFrame:
        try:
            return self.spark.read.schema(META_SCHEMA).parquet(f"{self.root}/*/*/meta/*")
        except AnalysisException as e:
            if not is_missing_path(e):
                raise
            return self.spark.createDataFrame([], META_SCHEMA)  # nothing stored yet

    def _registry_rows(self) -> list:
        # a few rows per stored sample: catalog metadata, safe on the driver
        if self._meta_rows is None:
            self._meta_rows = self.registry().collect()
        return self._meta_rows

    def _meta_row(self, table: str, sample_type: str, group_by: Sequence[str] | None = None):
        for row in self._registry_rows():
            if (row["table_name"] == table and row["sample_type"] == sample_type
                    and (group_by is None or row["group_list"] == list(group_by))):
                return row
        raise LookupError(f"no {sample_type} sample stored for {table}")

    def has_sample(self, table: str, sample_type: str) -> bool:
        try:
            self._meta_row(table, sample_type)
            return True
        except LookupError:
            return False

    def available_tiers(self, table: str) -> list[float]:
        return sorted(r["rate"] for r in self._registry_rows()
                      if r["table_name"] == table and r["sample_type"] not in OTHER_KINDS)

    def stratified_groups(self, table: str) -> list[tuple[str, ...]]:
        return [tuple(r["group_list"]) for r in self._registry_rows()
                if r["table_name"] == table and r["sample_type"] == "stratified"]

    def known_groups(self, table: str, group_by: Sequence[str]) -> DataFrame | None:
        """Every value of the group columns that the table had when its samples were built:
        from a stored list, or from the strata of a sample by these columns and maybe more.
        None where neither is stored."""
        want = set(group_by)
        for r in self._registry_rows():
            if r["table_name"] != table:
                continue
            base = r["data_path"].rsplit("/", 1)[0]
            if r["sample_type"] == "stratified" and want <= set(r["group_list"]):
                return self._read(f"{base}/strata").select(*group_by).distinct()
            for i, g in enumerate(r["known_groups"] or []):
                if want <= set(g):
                    return self._read(f"{base}/groups__{i}").select(*group_by).distinct()
        return None

    def tier(self, table: str, rate: float) -> DataFrame:
        """Rows of a uniform sample at ``rate`` from the newest tier build.

        A stored tier is a partition-pruned read; any smaller rate is cut
        from the smallest stored tier above it by the (pushed-down) hash
        filter, since the tiers nest.
        """
        tiers = [r for r in self.available_tiers(table) if r >= rate]
        if not tiers:
            raise LookupError(f"no stored tier of {table} at or above {rate}")
        meta = self._meta_row(table, tier_name(min(tiers)))
        data = self._rows(meta).filter(F.col("tier_ppm") <= F.lit(ppm(min(tiers))))
        if min(tiers) != rate:
            data = data.filter(F.col("h") < F.lit(threshold(rate)))
        return data.drop("tier_ppm")

    def _rows(self, meta) -> DataFrame:
        """The stored rows of a sample, wherever they lie."""
        # one reader per folder, so that each prunes its own tiers
        frames = [self._read(p) for p in meta["parts"] or [meta["data_path"]]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def priority(self, table: str, weight: str) -> DataFrame:
        """Rows of the stored priority sample by ``weight``, with ``inclusion``."""
        for r in self._registry_rows():
            if r["table_name"] == table and r["sample_type"] == "priority" and r["weight"] == weight:
                return self._rows(r)
        raise LookupError(f"no priority sample of {table} by {weight}")

    def outliers(self, table: str, value: str) -> tuple[DataFrame, Cut]:
        """Rows of the outlier index of ``value``, and the rule that made them outliers."""
        meta = self._outliers_row(table, value)
        return self._rows(meta), Cut(meta["center"], meta["cut"])

    def _outliers_row(self, table: str, value: str):
        for r in self._registry_rows():
            if r["table_name"] == table and r["sample_type"] == "outliers" and r["weight"] == value:
                return r
        raise LookupError(f"no outlier index of {table} by {value}")

    def outlier_aggregate(self, table: str, value: str, rate: float, aggs, group_by: Sequence[str] = (),
                          where=None, confidence: float = 0.95) -> DataFrame:
        """COUNT, SUM and AVG from the index of ``value`` and the other rows of the tier at ``rate``.
        An index and tiers that were built from different numbers of rows do not fit, and raise."""
        meta = self._outliers_row(table, value)
        tier = self._meta_row(table, tier_name(min([r for r in self.available_tiers(table) if r >= rate], default=rate)))
        if tier["population_rows"] != meta["population_rows"]:
            raise LookupError(f"the outlier index of {table} was built from {meta['population_rows']} rows, "
                              f"its tiers from {tier['population_rows']}: refresh them together")
        index, at = self.outliers(table, value)
        rest = self.tier(table, rate).where(~is_outlier(value, at))
        return outlier_aggregate(index, rest, meta["population_rows"] - meta["sample_rows"], aggs, group_by, where,
                                 value, at, confidence)

    def universe(self, table: str, key, rate: float | None = None) -> tuple[DataFrame, float]:
        """Rows of the drawn keys of ``table``, and the rate they were drawn at (``rate``, if a
        lower one is asked for)."""
        key = [key] if isinstance(key, str) else list(key)
        for r in self._registry_rows():
            if r["table_name"] == table and r["sample_type"] == "universe" and r["key_list"] == key:
                low = r["rate"] if rate is None else min(rate, r["rate"])
                rows = self._rows(r)
                return (rows if low == r["rate"] else rows.where(F.col("__key_hash") < threshold(low))), low
        raise LookupError(f"no sample of {table} by the keys {key}")

    def join_aggregate(self, left: str, right: str, left_key, right_key, aggs, group_by: Sequence[str] = (),
                       where=None, confidence: float = 0.95) -> DataFrame:
        """E5: COUNT, SUM and AVG over the join of two tables, from their stored key samples (at
        the lower of both rates; see :func:`roughcut.operators.universe.universe_join_aggregate`)."""
        rate = min(self.universe(left, left_key)[1], self.universe(right, right_key)[1])
        a, b = (self.universe(t, k, rate)[0].drop("__key_hash") for t, k in ((left, left_key), (right, right_key)))
        return universe_join_aggregate(a, b, left_key, right_key, rate, aggs, group_by, where,
                                       sampled=True, confidence=confidence)

    def _strat_meta(self, table: str, group_by):
        g = [group_by] if isinstance(group_by, str) else list(group_by)
        return self._meta_row(table, "stratified", g)

    def stratified_rows(self, table: str, group_by) -> DataFrame:
        return self._rows(self._strat_meta(table, group_by))

    def strata(self, table: str, group_by) -> DataFrame:
        data = self._strat_meta(table, group_by)["data_path"]
        return self._read(data.rsplit("/", 1)[0] + "/strata")

    # ---------------------------------------------------------------- answer
    def tier_aggregate(self, table: str, aggs, rate: float | None = None,
                       accuracy: float | None = None, where=None,
                       confidence: float = 0.95, bound_method: str = "proportion",
                       group_by: Sequence[str] = ()) -> DataFrame:
        """Aggregate answered from a stored tier.

        Grouped, with the groups known (:meth:`known_groups`), a group without a sampled
        (matching) row has COUNT and SUM 0, a COUNT of at most ``x_ci_high`` and unknown
        errors (NULL); with groups that nothing stored tells of, such groups are missing.

        COUNT/SUM are scaled by the tier's realised rate ``n/N`` read from
        the tier metadata, so the estimate is unbiased even though the tier
        holds slightly more or fewer than ``rate * N`` rows.
        """
        from roughcut.functions.bounds import tier_for_accuracy_py
        if rate is None:
            rate = tier_for_accuracy_py(0.95 if accuracy is None else accuracy)
        meta = self._meta_row(table, tier_name(rate))
        realised = meta["sample_rows"] / meta["population_rows"]
        res = sampling.aggregate_sample(self.tier(table, rate), as_aggs(aggs), realised,
                                        group_by=group_by, where=where, confidence=confidence,
                                        bound_method=bound_method,
                                        population=meta["population_rows"],
                                        sample_size=meta["sample_rows"])
        known = self.known_groups(table, group_by) if group_by else None
        if known is not None:
            res = sampling.with_all_groups(res, known, as_aggs(aggs), group_by, realised, rate, confidence)
        return res.withColumn("sample_type", F.lit(tier_name(rate)))

    def stratified_aggregate(self, table: str, group_by, aggs, where=None) -> DataFrame:
        """Grouped aggregate from the stored stratified sample.

        The sample is aggregated per stratum and joined to the stored strata
        table (``N_g``, ``n_g``) on the group key: both sides have one row
        per stratum, so the join cannot skew; Catalyst broadcasts the strata
        side when its file size is under the broadcast threshold.
        """
        from roughcut.functions import bounds
        from roughcut.operators.sampling import agg_sql, q
        g = [group_by] if isinstance(group_by, str) else list(group_by)
        aggs = as_aggs(aggs)
        rows = self.stratified_rows(table, g)
        if where is not None:
            rows = rows.filter(where)
        stats = [f"{agg_sql(a)} AS {q(a.name + '__s')}" for a in aggs]
        for a in aggs:
            if a.func in ("sum", "avg"):
                stats += [f"stddev_samp({q(a.column)}) AS {q(a.name + '__sd')}", f"count({q(a.column)}) AS {q(a.name + '__k')}"]
        agg = rows.groupBy(*g).agg(*[F.expr(x) for x in stats])
        stored = self.strata(table, g)
        known = {c: q(c) for c in stored.columns if c.startswith(("min__", "max__"))}
        strata = stored.select(*[F.col(c).alias(f"__s_{c}") for c in g], "sample_count", "population_count", *known)
        # null-safe: a NULL group value is a stratum like any other; a stratum without a
        # matching sampled row stays, with COUNT and SUM 0 and an upper bound
        cond = None
        for c in g:
            eq = F.col(c).eqNullSafe(F.col(f"__s_{c}"))
            cond = eq if cond is None else cond & eq
        j = strata.join(agg, cond, "left")
        n, N = "sample_count", "population_count"
        out = [f"{q('__s_' + c)} AS {q(c)}" for c in g]
        for a in aggs:
            v = q(a.name + "__s")
            if a.func == "count":
                v = f"coalesce({v}, 0)"
                out += [f"CAST(floor({v} * {N} / {n}) AS BIGINT) AS {q(a.name)}",
                        f"{v} AS {q(a.name + '_sample')}"]
                out += stratified.count_interval(a, v, n, N, where is not None)
            elif a.func == "sum":
                d = f"CAST({v} AS DOUBLE)" if where is None else f"coalesce(CAST({v} AS DOUBLE), 0.0D)"
                lo, hi = (known.get(f"{x}__{a.column}", "CAST(NULL AS DOUBLE)") for x in ("min", "max"))
                b = bounds.domain_sum_sql(d, q(a.name + "__sd"), f"coalesce({q(a.name + '__k')}, 0)", n, N, lo, hi)
                out += [f"{d} * {N} / {n} AS {q(a.name)}", f"{d} AS {q(a.name + '_sample')}"]
                out += [f"{b[x]} AS {q(a.name + '_' + x)}" for x in ("ci_low", "ci_high", "error_pct")]
            elif a.func == "avg":
                d = f"CAST({v} AS DOUBLE)"
                k = f"coalesce({q(a.name + '__k')}, 0)"
                m = bounds.avg_bound_sql(q(a.name + "__sd"), k, f"({k} * {N} / {n})")["margin"]
                out += [f"{d} AS {q(a.name)}",
                        f"CASE WHEN {d} != 0 THEN round({m} / abs({d}) * 100, 2) END AS {q(a.name + '_error_pct')}"]
            else:
                out.append(f"CAST({v} AS DOUBLE) AS {q(a.name)}")
        out += [n, N, f"{bounds.stratum_error_pct_sql(n, N)} AS error_pct"]
        return j.selectExpr(*out)

    # ---------------------------------------------------------------- refresh
    def refresh(self, table: str, df: DataFrame, profile_path: str | None = None) -> DataFrame:
        """Rebuild every sample stored for ``table`` from current data.

        Also makes the profile snapshot at ``profile_path`` stale, since it
        described the old data. Returns what happened, one row per version
        folder: ``action`` (``created`` or ``dropped``) and ``path``. The
        versions just superseded stay until the next refresh: a query planned
        on them can finish.
        """
        before = {r["data_path"] for r in self._registry_rows()}
        reg = (self.registry().filter(F.col("table_name") == table)
               .select("sample_type", "rate", "group_list", "key_list", "hash_method", "known_groups", "weight",
                       "sample_rows", "budget").collect())
        plain = [r for r in reg if r["sample_type"] not in OTHER_KINDS]
        tiers = sorted({r["rate"] for r in plain})
        known = next((r["known_groups"] for r in plain), None) or []
        keys = {(tuple(r["key_list"]), r["hash_method"] or "md5") for r in reg
                if r["sample_type"] not in ("universe", "outliers")}
        if len(keys) > 1 or not reg:
            raise LookupError(f"no samples (or mixed keys / hash methods) stored for {table}")
        key_cols, method = keys.pop() if keys else ((), "md5")
        key = list(key_cols)
        self._invalidate()
        if tiers:
            self.build_tiers(df, table, key, tiers, hash_method=method, known_groups=known)
        for r in reg:
            if r["sample_type"] == "stratified":
                self.build_stratified(df, table, r["group_list"], key, r["rate"],
                                      hash_method=method)
            elif r["sample_type"] == "priority":
                self.build_priority(df, table, r["sample_rows"], r["weight"], key, hash_method=method)
            elif r["sample_type"] == "outliers":
                self.build_outliers(df, table, r["weight"], r["budget"])
            elif r["sample_type"] == "universe":
                self.build_universe(df, table, r["key_list"], r["rate"], hash_method=r["hash_method"])
        if profile_path is not None:
            invalidate_profile(self.spark, profile_path)
        dropped = self.vacuum(table, keep_superseded=1)
        created = sorted({r["data_path"].rsplit("/", 1)[0] for r in self._registry_rows()
                          if r["data_path"] not in before})
        return self.spark.createDataFrame(
            [("created", p) for p in created] + [("dropped", p) for p in dropped],
            "action string, path string")

    def vacuum(self, table: str | None = None, abandoned_after_hours: float = 24.0,
               keep_superseded: int = 0) -> list[str]:
        """Delete superseded versions and abandoned builds; returns what went.

        Superseded: published builds older than the newest one of the same
        sample, but for the ``keep_superseded`` newest of them (new readers
        follow the newest build; queries planned before may still read the
        one it replaced).
        Abandoned: version folders that were never published (their build
        died) and are older than ``abandoned_after_hours`` - a younger one
        may be a build still running.
        """
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        Path = jvm.org.apache.hadoop.fs.Path

        def delete(p: str) -> None:
            path = Path(p)
            path.getFileSystem(conf).delete(path, True)

        current = {r["data_path"] for r in self._registry_rows()}
        in_use = {p.rsplit("/", 1)[0] for r in self._registry_rows() for p in r["parts"] or [r["data_path"]]}
        metas = self._all_meta().select("table_name", "data_path", "source").distinct().collect()
        published = {r[c].rsplit("/", 1)[0] for r in metas for c in ("data_path", "source") if r[c]}
        old: dict[str, list[str]] = {}  # superseded versions by sample folder
        for r in metas:
            if r["data_path"] not in current and (table is None or r["table_name"] == table):
                version_dir = r["data_path"].rsplit("/", 1)[0]
                old.setdefault(version_dir.rsplit("/", 1)[0], []).append(version_dir)
        gone = sorted(v for versions in old.values()
                      for v in sorted(set(versions), reverse=True)[keep_superseded:] if v not in in_use)
        for version_dir in gone:
            base, ver = version_dir.rsplit("/", 1)
            delete(version_dir)
            delete(f"{base}/meta/{ver}")

        cutoff_ms = (time.time() - abandoned_after_hours * 3600) * 1000
        root = Path(self.root)
        fs = root.getFileSystem(conf)
        if fs.exists(root):
            for t in fs.listStatus(root):
                if not t.isDirectory() or (table is not None and t.getPath().getName() != table):
                    continue
                for sample in fs.listStatus(t.getPath()):
                    if not sample.isDirectory():
                        continue
                    for child in fs.listStatus(sample.getPath()):
                        name = child.getPath().getName()
                        full = f"{self.root}/{t.getPath().getName()}/{sample.getPath().getName()}/{name}"
                        if (name.startswith("v") and full not in published
                                and child.getModificationTime() < cutoff_ms):
                            delete(full)
                            gone.append(full)
        self._invalidate()
        return gone
