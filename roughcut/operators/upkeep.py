"""Samples that follow their source files: an append reads the new files only.

A build from files remembers which they were (path, length, time). After new files were
added, :func:`append_files` reads just those and adds a delta to every sample of the table:

* tiers: the new rows below the thresholds, as a further folder; counts add up;
* stratified samples: per stratum the state (rows, rows below the threshold, least hash,
  extremes) merges with that of the new files; the rows that stand for strata without a row
  below the threshold are kept apart (a row per such stratum) and chosen anew.

Hash samples do not depend on the order rows come in, so the result equals a full rebuild
row for row. Deltas are further folders of the same sample; :func:`compact` (or an append
beyond ``max_parts``) rewrites them as one, from the sample alone. Every step writes a
new version and publishes it last, like any build. Files that were removed or
rewritten cannot be taken out of a sample: the append raises, or rebuilds if asked to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roughcut.functions.hashing import threshold, with_row_hash
from roughcut.operators import stratified
from roughcut.operators.samples import (DEFAULT_TIERS, OTHER_KINDS, SampleStore, _version, meta_row, now, ppm,
                                        tier_name)

MAX_PARTS = 16


class SourceChanged(RuntimeError):
    """Files that a sample was built from are gone or were rewritten."""


@dataclass(frozen=True)
class Upkeep:
    """What an append did: the files it read, and whether it had to rebuild."""
    files: list[str]
    rebuilt: bool = False


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of the Parquet files that lie below ``path`` now (contents are
    not read). Names pass through the driver, as they do for every reader of the table."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(path).select("path", "length", F.col("modificationTime").alias("modified")))
    return spark.createDataFrame(found.collect(), found.schema)


def new_rows(spark: SparkSession, path: str, files: Sequence[str]) -> DataFrame:
    """The rows of the named files of the table at ``path``."""
    return spark.read.option("basePath", path).parquet(*files)


def _base(store: SampleStore, table: str) -> str:
    return f"{store.root}/{table}/source"


def _band(rates: Sequence[float]) -> Column:
    return reduce(lambda c, r: F.when(F.col("h") < threshold(r), F.lit(ppm(r))).otherwise(c), sorted(rates, reverse=True),
                  F.lit(None).cast("int"))


def _groups(df: DataFrame, g: Sequence[str]) -> DataFrame:
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("population_count"))


def _merged(strata: DataFrame, g: Sequence[str]) -> DataFrame:
    """Strata states of several sets of rows as one."""
    aggs = [F.sum("population_count").alias("population_count"), F.sum("below_count").alias("below_count"),
            F.min("min_h").alias("min_h")]
    aggs += [(F.min if c.startswith("min__") else F.max)(F.col(f"`{c}`")).alias(c)
             for c in strata.columns if c.startswith(("min__", "max__"))]
    return strata.groupBy(*g).agg(*aggs).withColumn("sample_count", F.greatest("below_count", F.lit(1)).cast("bigint"))


def _forced(rows: DataFrame, strata: DataFrame, g: Sequence[str]) -> DataFrame:
    """The row of the least hash of every stratum without a row below the threshold."""
    empty = strata.where("below_count = 0").select(*[F.col(c).alias(f"__e_{c}") for c in g], F.col("min_h").alias("__e_h"))
    cond = F.col("h") == F.col("__e_h")
    for c in g:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__e_{c}"))
    return rows.join(empty, cond, "left_semi").dropDuplicates(list(g))


def _write_tiers(rows: DataFrame, rates: Sequence[float], path: str) -> None:
    (rows.where(F.col("h") < threshold(max(rates))).withColumn("tier_ppm", _band(rates))
        .hint("rebalance", "tier_ppm").sortWithinPartitions("h").write.partitionBy("tier_ppm").parquet(path))


def _publish(store: SampleStore, table: str, files: DataFrame, rows: dict[str, list]) -> None:
    """Write the list of files, then the metadata of each sample (its folder -> its rows)."""
    ver = _version()
    files.write.parquet(f"{_base(store, table)}/{ver}/files")
    for base, metas in rows.items():
        store._publish([meta_row(**m, source=f"{_base(store, table)}/{ver}/files") for m in metas], f"{base}/meta/{_version()}")


def build_from_files(store: SampleStore, path: str, table: str, key, rates: Sequence[float] = DEFAULT_TIERS,
                     strata: Sequence[tuple[Sequence[str], float]] = (), known_groups: Sequence[Sequence[str]] = (),
                     hash_method: str = "md5") -> None:
    """Build tiers and stratified samples (``strata``: group columns and rate) of the Parquet
    table at ``path`` that later appends can follow."""
    key = [key] if isinstance(key, str) else list(key)
    files = listing(store.spark, path)
    _take(store, path, table, key, sorted(set(map(float, rates))), [(list(g), r) for g, r in strata],
          [list(g) for g in known_groups], hash_method, [f["path"] for f in files.collect()], files, {})


def _take(store: SampleStore, path: str, table: str, key: list[str], rates: list[float], strata: list[tuple[list[str], float]],
          known: list[list[str]], method: str, files: list[str], listed: DataFrame, old: dict) -> None:
    """Add the rows of ``files`` to the samples of ``table`` (``old``: their metadata by folder)."""
    spark = store.spark
    rows = with_row_hash(new_rows(spark, path, files), key, method=method)
    out: dict[str, list] = {}
    same = {"table_name": table, "key_cols": ",".join(key), "key_list": key, "hash_method": method, "built_at": now()}
    if rates:
        base, ver = store._tiers(table), _version()
        data, seen = f"{base}/{ver}/data", Observation()
        _write_tiers(rows.observe(seen, F.count(F.lit(1)).alias("rows")), rates, data)
        bands = dict(spark.read.parquet(data).groupBy("tier_ppm").count().select("tier_ppm", "count").collect())
        before = old.get(base, [])
        for i, g in enumerate(known):
            groups = _groups(rows, g)
            if before:
                last = spark.read.parquet(f"{before[0]['data_path'].rsplit('/', 1)[0]}/groups__{i}")
                groups = groups.unionByName(last).groupBy(*g).agg(F.sum("population_count").alias("population_count"))
            groups.write.parquet(f"{base}/{ver}/groups__{i}")
        had = {m["rate"]: m for m in before}
        parts = (before[0]["parts"] if before else []) + [data]
        cum = {r: sum(n for p, n in bands.items() if p <= ppm(r)) + (had[r]["sample_rows"] if r in had else 0) for r in rates}
        population = seen.get["rows"] + (before[0]["population_rows"] if before else 0)
        out[base] = [same | {"sample_type": tier_name(r), "rate": r, "sample_rows": cum[r], "population_rows": population,
                             "stored_rows": cum[rates[-1]], "data_path": data, "known_groups": known, "parts": parts}
                     for r in rates]
    for g, rate in strata:
        base, ver = store._strat(table, g), _version()
        here, before = f"{base}/{ver}", old.get(base, [])
        state = stratified.strata_table(rows, g, rate, extremes=True)
        if before:
            last = before[0]["data_path"].rsplit("/", 1)[0]
            state = state.unionByName(spark.read.parquet(f"{last}/strata"), allowMissingColumns=True)
        _merged(state, g).write.parquet(f"{here}/strata")
        merged = spark.read.parquet(f"{here}/strata")
        rows.where(F.col("h") < threshold(rate)).hint("rebalance").write.parquet(f"{here}/data")
        forced = _forced(rows, merged, g)
        if before:
            forced = _forced(rows.unionByName(spark.read.parquet(f"{last}/forced")), merged, g)
        forced.write.parquet(f"{here}/forced")
        kept = [p for p in before[0]["parts"] if not p.endswith("/forced")] if before else []
        size = merged.agg(F.sum("sample_count").alias("s"), F.sum("population_count").alias("n")).first()
        out[base] = [same | {"sample_type": "stratified", "rate": float(rate), "group_cols": ",".join(g), "group_list": g,
                             "sample_rows": size["s"], "population_rows": size["n"], "stored_rows": size["s"],
                             "data_path": f"{here}/data", "parts": [*kept, f"{here}/data", f"{here}/forced"]}]
    _publish(store, table, listed, out)


def append_files(store: SampleStore, path: str, table: str, rebuild: bool = False, max_parts: int = MAX_PARTS) -> Upkeep:
    """Bring the samples of ``table`` up to date with the files at ``path``; only files that
    were not there at the last build or append are read.

    Files that are gone or were rewritten raise :class:`SourceChanged`, or with ``rebuild`` make
    this a full build. Samples with more than ``max_parts`` folders are compacted.
    """
    metas = [r for r in store._registry_rows() if r["table_name"] == table and r["source"]]
    if not metas:
        raise LookupError(f"no sample of {table} that follows its files")
    # all samples of a table follow the same files; an append that died part way left older lists
    lists = {m["source"] for m in metas}
    if len(lists) > 1 and not rebuild:
        raise SourceChanged(f"the samples of {table} follow different files; rebuild")
    now_there, known_files = listing(store.spark, path), store.spark.read.parquet(max(lists))
    same = ["path", "length", "modified"]
    gone = known_files.join(now_there, same, "left_anti").select("path").limit(3).collect()
    fresh = [r["path"] for r in now_there.join(known_files, same, "left_anti").select("path").collect()]
    tiers = [m for m in metas if m["sample_type"] not in OTHER_KINDS]
    strat = [m for m in metas if m["sample_type"] == "stratified"]
    args = (metas[0]["key_list"], sorted(m["rate"] for m in tiers), [(m["group_list"], m["rate"]) for m in strat],
            (tiers[0]["known_groups"] if tiers else None) or [], metas[0]["hash_method"])
    if gone or len(lists) > 1:
        if not rebuild:
            raise SourceChanged(f"gone or rewritten since the samples of {table} were built: {[r['path'] for r in gone]}")
        everything = [r["path"] for r in now_there.select("path").collect()]
        _take(store, path, table, *args, everything, now_there, {})
        return Upkeep(everything, True)
    if fresh:
        old: dict[str, list] = {}
        for m in metas:
            old.setdefault(m["data_path"].rsplit("/", 2)[0], []).append(m)
        _take(store, path, table, *args, fresh, now_there, old)
        if any(len(m["parts"]) > max_parts for m in store._registry_rows() if m["table_name"] == table and m["source"]):
            compact(store, table)
    return Upkeep(fresh)


def compact(store: SampleStore, table: str) -> None:
    """Rewrite the folders of every sample of ``table`` that follows files as one folder each;
    reads the samples, not the table."""
    spark = store.spark
    metas = [r for r in store._registry_rows() if r["table_name"] == table and r["source"]]
    by_folder: dict[str, list] = {}
    for m in metas:
        by_folder.setdefault(m["data_path"].rsplit("/", 2)[0], []).append(m)
    for base, rows in by_folder.items():
        ver, last = _version(), rows[0]["data_path"].rsplit("/", 1)[0]
        here, parts = f"{base}/{ver}", [p for p in rows[0]["parts"] if not p.endswith("/forced")]
        data = store._rows(rows[0].asDict() | {"parts": parts})
        if rows[0]["sample_type"] == "stratified":
            data.hint("rebalance").write.parquet(f"{here}/data")
            for part in ("strata", "forced"):
                spark.read.parquet(f"{last}/{part}").write.parquet(f"{here}/{part}")
            fresh = [f"{here}/data", f"{here}/forced"]
        else:
            data.hint("rebalance", "tier_ppm").sortWithinPartitions("h").write.partitionBy("tier_ppm").parquet(f"{here}/data")
            for i in range(len(rows[0]["known_groups"] or [])):
                spark.read.parquet(f"{last}/groups__{i}").write.parquet(f"{here}/groups__{i}")
            fresh = [f"{here}/data"]
        store._publish([meta_row(**{f: m[f] for f in m.__fields__ if f not in ("realised_rate", "storage_overhead")}
                                 | {"data_path": f"{here}/data", "parts": fresh, "built_at": now()}) for m in rows],
                       f"{base}/meta/{ver}")
