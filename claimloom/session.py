"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    # Skewed keys are split, small partitions merged and joins re-planned from real sizes,
    # so no operator forces a broadcast of data that may grow.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "claimloom", **options: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, which every executor must reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name of its own below the folder for intermediate tables."""
    return f"{_scratch.get() or _shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Inside, ``durable`` writes below the folder that this gives, for ``remove`` to delete."""
    folder = new_folder(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)


def _hadoop_path(spark: SparkSession, path: str):
    """A path as Spark's default file system sees it, and that file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(found), system


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables; one that is not there is no error."""
    path, system = _hadoop_path(spark, folder)
    system.delete(path, True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob pattern finds, in order."""
    path, system = _hadoop_path(spark, pattern)
    return sorted(x.getPath().toString() for x in system.globStatus(path) or [])


def qualified(spark: SparkSession, path: str) -> str:
    """The URI that Spark means by a path."""
    return _hadoop_path(spark, path)[0].toString()


#: Tables hold whole texts several times over; this takes half of what Spark's own choice takes for them.
CODEC = "zstd"


def durable(df: DataFrame) -> DataFrame:
    """Write a costly result as a table in the shared folder and go on from there.

    It survives lost executors, so nothing above it runs twice, and as Parquet its readers
    load only the columns they need.  The folder comes from ``spark.checkpoint.dir``; only
    a local session without one gets a folder of its own.
    """
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of whole texts that a task hands to Python at once; Spark's own 10,000 take tens of MB on both sides.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """From now on, the session hands at most ``BATCH_ROWS`` rows at once to Python; it changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over the cores if fewer partitions than there are cores hold rows.

    For inputs whose work per row is heavy: one small file would otherwise be one task, and so
    would a file of one row group, however many partitions it is cut into.  A scan without columns
    tells.  A large input has many filled partitions and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    planned = df.rdd.getNumPartitions()
    if planned >= cores and df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(max(cores, planned))


def dealt(df: DataFrame) -> DataFrame:
    """Deal rows out over tasks, for small rows that each make a great deal.

    How many partitions rows arrive in says nothing about that work, and adaptive execution would
    put few small rows into one task.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
