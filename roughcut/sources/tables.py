"""Parquet sources and sinks (inventory A1-A3, A5).

Everything is a lazy ``DataFrame``: projections and filters written after a
call here are pushed into the Parquet scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roughcut.functions.hashing import hash60

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Row keys that identify a row uniquely (needed by deterministic sampling).
ROW_KEYS = {
    "sales": ("event_id",),
    "events": ("event_id",),
    "orders": ("o_orderkey",),
    "customer": ("c_custkey",),
    "documents": ("doc_id",),
    # (l_orderkey, l_linenumber) repeats; the four-column key is unique
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
}

# Region split of the skewed fixture by event_id % 1000
#   < 900 -> 'US', < 998 -> 'UK', otherwise 'Antarctica'  (90 % / 9.8 % / 0.2 %)
REGION_CUTS = ((900, "US"), (998, "UK"))
REGION_REST = "Antarctica"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A1: scan one Parquet table."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """A1: expose tables as temp views for ``spark.sql``."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
    load_sales(spark, sf_dir).createOrReplaceTempView("sales")


def skewed_region(id_col: str) -> F.Column:
    bucket = F.col(id_col) % 1000
    expr = None
    for cut, name in REGION_CUTS:
        expr = F.when(bucket < cut, F.lit(name)) if expr is None else expr.when(bucket < cut, F.lit(name))
    return expr.otherwise(F.lit(REGION_REST))


def derive_sales(events: DataFrame) -> DataFrame:
    """A2 (deterministic form): the skewed ``sales`` table derived from events.

    ``user_id BIGINT, region STRING, amount DECIMAL(10,2), date TIMESTAMP``
    plus the row key ``event_id``. Pure projection: no shuffle, and the
    columns a later query does not use are pruned from the scan.
    """
    return events.select(
        F.col("event_id"),
        F.col("user_id"),
        skewed_region("event_id").alias("region"),
        F.col("value").cast("decimal(10,2)").alias("amount"),
        F.col("ts").alias("date"),
    )


def load_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_sales(read_table(spark, sf_dir, "events"))


def sales_with_hash(spark: SparkSession, sf_dir: str, method: str = "md5") -> DataFrame:
    """``sales`` plus the 60-bit row hash ``h`` used by every sampler."""
    return load_sales(spark, sf_dir).withColumn("h", hash60("event_id", method))


def generate_sales(spark: SparkSession, n_rows: int, seed: int = 42,
                   num_partitions: int | None = None) -> DataFrame:
    """A2: random skewed table like the reference's generator.

    ``user_id`` uniform on 0..1e6, region 90 / 9.8 / 0.2 %, amount uniform
    on 0..1000 with two decimals, date within the last 365 days. Built from
    ``spark.range`` so every partition generates its own rows.
    """
    ids = spark.range(0, n_rows, 1, num_partitions)
    u = F.rand(seed)
    return ids.select(
        F.col("id").alias("event_id"),
        F.floor(F.rand(seed + 1) * 1_000_000).cast("bigint").alias("user_id"),
        F.when(u < 0.9, "US").when(u < 0.998, "UK").otherwise(REGION_REST).alias("region"),
        (F.rand(seed + 2) * 1000).cast("decimal(10,2)").alias("amount"),
        (F.current_timestamp() - F.make_interval(
            days=F.floor(F.rand(seed + 3) * 365).cast("int"))).alias("date"),
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> str:
    """A3/A5: Parquet sink. Task retries are safe (output committer)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
