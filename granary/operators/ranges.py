"""Places in an order over a whole table, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place in ``order``, from 1; equal rows follow each other in no stated order.

    Ranges are sorted on their own and stored; a place is the number of rows in the ranges
    before, one number each, and the number of the row in its own. Rows of one order key
    share a range, so the order should end with a key.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("row")
    keys = [F.struct(o.alias("at")).alias(f"k{i}") for i, o in enumerate(order)]
    rows = settled(df.select(row, *keys))  # ranges are sampled from it
    by = [F.col(f"k{i}") for i in range(len(order))]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()))
    ranged = ranged.select("row", F.shiftright("id", 33).cast("int").alias("range"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("own"))
    starts, total = [], 0
    for number, count in ranged.groupBy("range").agg(F.count(F.lit(1))).orderBy("range").collect():  # a row for each partition
        starts.append((number, total))
        total += count
    known = df.sparkSession.createDataFrame(starts, "range int, start long")
    return ranged.join(F.broadcast(known), "range").select("row.*", (F.col("start") + F.col("own") + 1).alias(name))
