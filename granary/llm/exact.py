"""Exact dedup by content sort (operator 6).

Sampled splitters range-partition the normalised texts, an external sort inside
each partition puts equal texts next to each other, and full comparisons of
neighbours form the groups. The splitters are short (the first characters of the
normalised text, and a hash that spreads texts with a common beginning), so the
sample on the driver stays small however long the texts are.

A text that holds more than a set share of all rows would fill one partition. Such
texts are few (the share bounds their number); their rows are combined in the map
tasks instead and never meet in one task. Both ways form the same groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, heavy_table, heavy_values

HEAD = 48  # characters of a splitter
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, SPACE + "+", "")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", only_kept: bool = False) -> DataFrame:
    """All rows and columns of ``df`` with ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256`` (of the normalised text). With ``only_kept``, one row of each group.

    Equal are texts that match after all ASCII white space is deleted; null counts
    as empty, and all empty texts are one group. Of a group the row with the most code
    points in its original text stays, then the one with the smallest identifier; a
    null identifier comes last. Of rows that tie in both, exactly one is kept. An empty
    table gives an empty result. Columns of ``df`` with the added names are replaced,
    all others stay as they are, whatever their names.
    """
    columns = [c for c in df.columns if c not in ADDED]
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    # The columns of the caller travel inside one struct, apart from the working columns.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = rows.select("row", F.xxhash64(normalised(text)).alias("hash"), F.length(text).alias("len"), F.col("row")[id_col].alias("id"))
    named = [*[F.col("row")[c].alias(c) for c in columns], "keep_id", "group_size", "kept", "text_sha256"]
    found = heavy_values(rows.select("hash"), "hash")
    heavy = heavy_table(rows, "hash", found).select("hash")

    # Sort: range partitions by (head, hash), equal texts adjacent, ranked by length and identifier.
    light = rows.join(heavy, "hash", "left_anti") if found else rows
    light = light.withColumn("head", F.substring(normalised(text), 1, HEAD))
    light = light.repartitionByRange("head", "hash").withColumn("norm", normalised(text))
    group = Window.partitionBy("head", "hash", "norm")
    ranked = group.orderBy(F.desc("len"), F.asc_nulls_last("id"))
    out = light.withColumns({"kept": F.row_number().over(ranked) == 1, "keep_id": F.first("id").over(ranked), "group_size": F.count(F.lit(1)).over(group), "text_sha256": F.sha2("norm", 256)})
    out = out.select(*named)

    if found:
        # Few texts, many rows: one row of each text and task is shuffled, and the groups are broadcast.
        crowd = rows.join(heavy, "hash", "left_semi").withColumn("text_sha256", F.sha2(normalised(text), 256))
        best = F.min(F.struct((-F.col("len")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
        groups = crowd.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
        crowd = crowd.join(F.broadcast(groups), "text_sha256").withColumn("keep_id", F.col("best.id"))
        first = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("len") == -F.col("best.n"))
        # Rows that tie with the first are repeated rows of one identifier: a few at most.
        tied = crowd.filter(first).withColumn("kept", F.row_number().over(Window.partitionBy("text_sha256").orderBy("id")) == 1)
        crowd = crowd.filter(~first).withColumn("kept", F.lit(False)).select(*named).unionByName(tied.select(*named))
        out = out.unionByName(crowd)
    return out.filter("kept") if only_kept else out
