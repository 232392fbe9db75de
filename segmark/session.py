"""Session helpers: a local session for tests and benches, and cut-points in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session; on a cluster the caller brings its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("segmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders of local sessions that name none themselves; each goes with the process.
_LOCAL: dict[str, tempfile.TemporaryDirectory] = {}


#: Cut-points that this process has written and not cleared.
_CUTS: list[str] = []


def clear_cuts(spark: SparkSession) -> int:
    """Deletes the cut-points written so far, once nothing lazy needs them any more; says how many."""
    done = 0
    while _CUTS:
        where = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        done += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return done


def cut_folder(spark: SparkSession) -> str:
    """Shared folder for cut-points: the one the cluster names, else (tests only) a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.TemporaryDirectory(prefix="spark-segmark-", dir="/tmp")
        named = _LOCAL[app].name
    return named.rstrip("/")


def cut_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`clear_cuts` knows of."""
    path = f"{cut_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _CUTS.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several branches need the same costly rows, and between the rounds of an iterative
    job: the written table survives lost executors, is pruned per branch, and ends the lineage.
    """
    path = cut_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Recordings or files that Spark hands to a Python worker at once.
WIDE_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int = WIDE_ROWS) -> Iterator[None]:
    """For jobs that run inside: Arrow batches of at most ``rows`` rows, as their rows are whole recordings or files."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
