"""Session defaults, the shared scratch folder, and materialisation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_base: str | None = None
_kept: list[DataFrame] = []


def build_session(app: str = "cartloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    Cluster sizing (executors, memory, shuffle partitions) is left to the
    submitter; AQE coalesces or splits the shuffle partitions at run time.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Streaming state on the executors' disks instead of the heap.
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _base_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    global _local_base
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="cartloom-")
    return _local_base


def _session_dir(spark: SparkSession) -> str:
    """This application's own folder under the shared one."""
    return os.path.join(_base_dir(spark), "cartloom", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing exists there yet."""
    return os.path.join(_session_dir(spark), f"{label}-{uuid.uuid4().hex}")


def clear(spark: SparkSession) -> None:
    """Remove what this application settled, and release what it kept.

    For the end of a job: results not yet written out can't be read any more.
    """
    while _kept:
        _kept.pop().unpersist()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor re-reads files instead of
    recomputing the job, and freezes partition-dependent columns. The
    shuffles on the way there are removed from the executors' disks: no later step reads them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Persist a table that one job reads several times (spills to disk), until ``clear``."""
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _kept[-1]


def shuffled(df: DataFrame) -> DataFrame:
    """Ask for a shuffled join with ``df``.

    For joins that multiply rows: broadcasting a side, however small, would
    leave them to the few tasks that scan the other side. The shuffle spreads
    them by key, and AQE still splits skewed keys.
    """
    return df.hint("merge")


BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table whose counted size allows it, else leave the join to Spark."""
    return F.broadcast(df) if rows <= most else df
