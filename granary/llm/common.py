"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space: the separators of words wherever an operator counts words.
SPACE = r"[\x20\x09-\x0D]"


def text_of(col: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text (maximal runs without ASCII white space)."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text, without building them."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once per row.

    A higher-order function would otherwise compute an inlined expression once
    per element of the array it walks.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session; block counts scale with it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none (tests, single-node runs) a local folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "granary-checkpoints")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder for tables of one run, in the shared folder.

    What lies there is removed when the application ends; ``remove`` does it earlier.
    """
    top = f"{shared_dir(spark).rstrip('/')}/granary-{spark.sparkContext.applicationId}"
    files, at = _file_system(spark, top)
    if files.mkdirs(at):
        files.deleteOnExit(at)
    return f"{top}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of this run that nothing reads any more."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, computed once; its lineage ends there."""
    spark = df.sparkSession
    path = path or new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heavy_values(df: DataFrame, key: str) -> list[tuple]:
    """(value, parts) of the values of a column that hold more rows than a quarter of an
    even partition, with the number of such quarters; null is a value.

    At most four times the number of partitions can, so the list that passes through
    the driver, and a table of it, are bounded. Counts are combined in the map tasks; a
    floor of 64 rows keeps small tables out.
    """
    least = max(64, df.count() // (4 * partitions(df.sparkSession)))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    return [(r[0], -(-r[1] // least)) for r in counts.collect()]


def heavy_table(df: DataFrame, key: str, found: list[tuple]) -> DataFrame:
    """(key, parts) of the values that ``heavy_values`` found, without null, for a broadcast."""
    return F.broadcast(df.sparkSession.createDataFrame([x for x in found if x[0] is not None], f"`{key}` {df.schema[key].dataType.simpleString()}, parts long"))


def spread_join(left: DataFrame, right: DataFrame, key: str, salt: Column, how: str = "inner", found: list[tuple] | None = None) -> DataFrame:
    """``left`` joined with ``right`` (few rows of a key) on ``key``, hot keys dealt over tasks.

    Rows of ``left`` with a hot key are dealt by the hash of ``salt`` into as many parts
    as that key fills, and its rows of ``right`` are repeated once for each part. ``how``
    keeps rows of ``left`` only: inner, left, left_semi or left_anti. ``found``: the hot
    keys, where ``left`` is no table and should not be computed for them.
    """
    found = heavy_values(left, key) if found is None else found
    if not found:
        return left.join(right, key, how)
    few = heavy_table(left, key, found).select(F.col(key).alias("_hot"), F.col("parts").alias("_parts"))
    none = dict(found).get(None, 1)
    parts = F.coalesce(F.col("_parts"), F.lit(1).cast("long"))
    dealt = F.pmod(F.xxhash64(salt), F.when(F.col(key).isNull(), F.lit(none)).otherwise(parts))
    one = left.join(few, F.col(key) == F.col("_hot"), "left").withColumn("_part", dealt).drop("_hot", "_parts")
    two = right.join(few, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_hot", "_parts")
    return one.join(two, [key, "_part"], how).drop("_part")
