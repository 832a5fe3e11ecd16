"""Session helpers: building a local session for tests and locating the
shared folder that written samples, profiles and checkpoints live in.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names
(HDFS, S3, ABFS, ...). We only invent one when that setting is unset, which
happens in local runs and tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "roughcut", extra_conf: dict | None = None) -> SparkSession:
    """A local session configured the way the tests and the bench expect.

    AQE stays on so shuffle partitions coalesce and skewed partitions split
    at run time; the UI is off (no server is started).
    """
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shuffle_partitions_for(input_bytes: int, cores: int,
                           target_bytes: int = 128 * 1024 * 1024) -> int:
    """Initial ``spark.sql.shuffle.partitions`` for an input size.

    About one partition per ``target_bytes`` of input, at most two per
    core; AQE then coalesces small partitions and splits skewed ones at run
    time. (On a cluster: set it from the table size the same way and let
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` steer AQE.)
    """
    return max(1, min(2 * max(cores, 1), -(-input_bytes // target_bytes)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder, setting one only if unset.

    The configured value is always preferred. Without one, a ``local`` master
    gets a temporary folder (its executors are this machine); on any other
    master that folder would be invisible to the executors, so the call raises.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        # setCheckpointDir appends a UUID folder; its parent is the shared root
        return current.rstrip("/").rsplit("/", 1)[0]
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that the executors of {sc.master} share")
    root = tempfile.mkdtemp(prefix="roughcut-ckpt-")
    sc.setCheckpointDir(root)
    return root


def is_missing_path(error: AnalysisException) -> bool:
    """Whether a read failed because there is nothing at its path."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def shared_dir(spark: SparkSession, *parts: str, per_app: bool = True) -> str:
    """A folder below the shared root, e.g. ``shared_dir(spark, "samples")``.

    ``per_app=True`` (scratch data) puts it under the application id so
    concurrent runs cannot overwrite each other; ``per_app=False`` gives a
    stable location that later sessions find again (stored samples).
    """
    root = ensure_checkpoint_dir(spark)
    scope = [spark.sparkContext.applicationId] if per_app else ["shared"]
    return "/".join([root, "roughcut", *scope, *parts])


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has written below the shared folder (stable locations,
    such as stored samples of ``per_app=False``, stay). Call it when no result that reads
    those tables is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, *name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage the way a checkpoint does, in compressed columns whose
    size Catalyst knows: a lost executor costs a reread, not a recomputation,
    and several consumers share one computation.
    """
    spark = df.sparkSession
    path = shared_dir(spark, *name[:-1], f"{name[-1]}-{uuid.uuid4().hex}") + "/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
