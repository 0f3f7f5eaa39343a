"""Session helpers: building a local session for tests and tools, and the
shared folder used to cut lineage.

On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared file
system path set by the cluster).  Only when that setting is absent, as in a
local test run, a folder under the system temp directory is created and set.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "topictone") -> SparkSession:
    """A local session configured like the tests and the benchmark expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session (created if unset)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        # A folder of this machine is shared with the executors only in local mode.
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="topictone-ckpt-")
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and
    continue from the files (lineage cut, computed once).

    Files on the shared file system survive the loss of executors, unlike a
    local checkpoint or cached blocks.  (A reliable ``Dataset.checkpoint``
    would compute an uncached plan twice: once for its action, once to write.)
    """
    return write_shared(df, name)


#: Tables written since the innermost ``owned_tables`` block began.
_OWNED: list[list[str]] = []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_kind(spark: SparkSession, path: str) -> str:
    """'folder', 'file' or 'none', on whatever file system the path is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return "none"
    return "folder" if fs.getFileStatus(target).isDirectory() else "file"


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Intermediate tables written in the block are removed at its end; results
    that are read from them must be written elsewhere before."""
    own: list[str] = []
    _OWNED.append(own)
    try:
        yield own
    finally:
        _OWNED.remove(own)
        for path in own:
            remove_path(spark, path)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.
    The table stays until its ``owned_tables`` block, if any, ends."""
    path = shared_path(df.sparkSession, name)
    if _OWNED:
        _OWNED[-1].append(path)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin a *small* table over the cluster before CPU-heavy per-row work
    (tokenising, model inference).

    A small table may sit in one file or row group and so in one scan task.  The
    plan's size estimate decides: a table of at least one full scan split
    (``spark.sql.files.maxPartitionBytes``) per task slot is returned unchanged, so
    large text is never moved; below that at most one split per slot moves."""
    if df.isStreaming:
        return df   # a stream's micro-batches are partitioned by its source
    spark = df.sparkSession
    try:
        target = partitions or spark.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
            spark.conf.get("spark.sql.files.maxPartitionBytes")))
    except Exception:  # noqa: BLE001 - Spark Connect has no access to the plan
        return df
    if math.ceil(size / split) >= target:
        return df
    files = len(df._jdf.inputFiles())   # of a small table only
    return df.repartition(target) if 0 < files < target else df
