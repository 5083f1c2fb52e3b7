"""Sinks that a repeated micro-batch does not change, and marks of what was told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is a folder of its own under ``path``, written whole.

    A batch that is repeated after a failure, also one between its write and its commit,
    replaces its folder. ``row`` numbers rows over all batches, in order of batches.
    """

    def write(rows: DataFrame, batch: int) -> None:
        numbered = rows.withColumn("row", F.lit(batch).cast("long") * (1 << 43) + F.monotonically_increasing_id())
        numbered.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What the batches under ``path`` hold."""
    return spark.read.parquet(path)


def untold(requests: DataFrame, marks: DataFrame, key: str = "row") -> DataFrame:
    """Requests that no mark names yet."""
    return requests.join(marks.select(key).distinct(), key, "left_anti")


def mark(requests: DataFrame, path: str, run: int, key: str = "row") -> None:
    """Marks requests as told, in a folder for the run; a repeated run replaces its own marks."""
    requests.select(key).distinct().write.mode("overwrite").parquet(f"{path}/run={run}")
