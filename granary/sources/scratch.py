"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session may leave it unset (tests, single-node runs); it gets one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="granary-"))
    return named or context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one; it is removed when the application ends."""
    top = f"{shared_folder(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.mkdirs(at):
        files.deleteOnExit(at)
    return f"{top}/{kind}-{uuid.uuid4().hex}"


LEAST_ROWS, MOST_ROWS = 500, 10_000  # of a task with much work for each row


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over tasks by its number of rows.

    Files are dealt by their bytes, so one task reads a million narrow rows. Where each of them
    is much work, such as texts to parse, they are dealt out first: to all cores, and then to as
    many tasks as ``MOST_ROWS`` ask for.
    """
    rows = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, -(-rows // LEAST_ROWS)), -(-rows // MOST_ROWS)))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, where its lineage ends."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
