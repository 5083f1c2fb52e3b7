"""Counts, retention and rate limits over a table of events."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, most frequent first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def window_counts(df: DataFrame, time: str, by: str, now: Column, zone: str) -> DataFrame:
    """By group: rows of the local day, of the last seven days, and all, in one pass."""
    day = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, zone)), zone)
    week = now - F.expr("interval 7 days")
    return df.groupBy(by).agg(F.count_if(F.col(time) >= day).alias("today"), F.count_if(F.col(time) >= week).alias("week"), F.count(F.lit(1)).alias("total"))


def purge(df: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Rows not older than the cutoff; those exactly at it stay."""
    return df.filter(F.col(time) >= cutoff)


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Latest row of each key of a table and its updates."""
    both = table.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), time).alias("_r"))
    return latest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def recent_requests(df: DataFrame, user: str, time: str, order: str, limit: int, seconds: int = 3600) -> DataFrame:
    """Each event with the number of earlier ones of its user within the trailing window.

    ``over`` marks those at or over the limit when rejected events count too, an upper
    bound of what the stateful limiter rejects. Times count in whole seconds.
    """
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    trailing = Window.partitionBy(user).orderBy("_s").rangeBetween(-(seconds - 1), 0)
    same = Window.partitionBy(user, "_s").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    # Of events in one second only those with a smaller number are earlier.
    out = df.withColumn("_s", at).withColumn("recent", F.count(F.lit(1)).over(trailing) - F.count(F.lit(1)).over(same))
    return out.withColumn("over", F.col("recent") >= limit).drop("_s")


def forget_users(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of users that have not withdrawn their consent (``gone`` has their keys)."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def newest(df: DataFrame, order: str, k: int) -> DataFrame:
    """The ``k`` newest rows, newest first."""
    return df.orderBy(F.desc(order)).limit(k)


def limited(df: DataFrame, user: str, time: str, order: str, limit: int, seconds: int = 3600) -> DataFrame:
    """Each request with ``accepted`` and, where it is not, ``wait_minutes``.

    A request is accepted when fewer than ``limit`` of its user were accepted in the
    ``seconds`` before; otherwise the user waits until the oldest of the last ``limit``
    leaves the window, in whole minutes. A request at the very end of the window is
    out of it. Users are sorted inside their partitions and read as a stream, with the
    last ``limit`` times of one user in memory, however many requests that user made.
    Columns pass through untouched; repeated rows are requests of their own; requests
    without a user or a time are accepted, as nothing counts against them.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, deque(maxlen=limit)
        for rows in batches:
            accepted, waits = [], []
            for who, at in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                if who is None or at is None:
                    accepted.append(True)
                    waits.append(None)
                    continue
                if who != now:
                    now, taken = who, deque(maxlen=limit)
                free = len(taken) < limit or at - taken[0] >= seconds
                accepted.append(free)
                waits.append(None if free else max(1, math.ceil((taken[0] + seconds - at) / 60)))
                if free:
                    taken.append(at)
            fields = [*list(rows.schema)[2:], pa.field("accepted", pa.bool_()), pa.field("wait_minutes", pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns[2:], pa.array(accepted, pa.bool_()), pa.array(waits, pa.int64())], schema=pa.schema(fields))

    columns = [c for c in df.columns if c not in ("accepted", "wait_minutes")]
    keyed = df.select(F.col(user).alias("_user"), F.unix_seconds(F.col(time).cast("timestamp")).alias("_at"), *[F.col(c) for c in columns])
    # Rows without a user or time are dealt by their number: they are no group.
    dealt = keyed.repartition("_user", F.when(F.col("_user").isNull() | F.col("_at").isNull(), F.xxhash64(order)))
    schema = T.StructType([*[df.schema[c] for c in columns], T.StructField("accepted", T.BooleanType()), T.StructField("wait_minutes", T.LongType())])
    return dealt.sortWithinPartitions("_user", "_at", order).mapInArrow(decide, schema)
