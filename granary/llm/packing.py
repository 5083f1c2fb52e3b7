"""Packing into optimal length buckets (operator 9).

Rows are padded to the longest length of their bucket. The bucket limits that
minimise padding over the whole corpus come from dynamic programming over the
global length histogram, whose size is bounded whatever the corpus: lengths below
512 are exact, longer ones fall into cells one 256th of their size wide, and each
cell keeps its count, sum and largest length. Inside a bucket rows take the order
of a hash, or that of the stream they come from, and are cut into batches of a token
budget; the exact position of a row comes from block counts, so a bucket with most of
the rows is no single task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_of, word_count

# Production parameters of the registered query and the pipeline stage.
BUCKETS = 16
TOKEN_BUDGET = 65_536  # padded tokens of a batch
BLOCK_ROWS = 4096  # expected rows of a block inside a bucket


def length_cell(length: Column) -> Column:
    """Upper end of the histogram cell of a length; exact below 512."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(length)) - 9, F.lit(0)))
    return F.when(length < 512, length).otherwise(F.ceil(length / width).cast("long") * width)


def optimal_limits(cells: list[tuple[int, int]], buckets: int) -> list[int]:
    """Limits that minimise padding for (longest length, rows) in order of length.

    ``best[j]`` is the least padded size of the first j cells with the buckets used
    so far; a further bucket over cells i to j costs rows(i..j) times the longest
    length of cell j. At most ``buckets`` limits are returned, the last one the
    longest length of all.
    """
    if not cells:
        return []
    longest = np.array([c[0] for c in cells], dtype=np.float64)
    rows = np.concatenate([[0.0], np.cumsum([c[1] for c in cells], dtype=np.float64)])
    n = len(cells)
    best = np.concatenate([[0.0], rows[1:] * longest])
    cuts = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.zeros(n + 1, dtype=np.int64)
        cut[1:] = -1
        for j in range(1, n + 1):
            costs = best[:j] + (rows[j] - rows[:j]) * longest[j - 1]
            i = int(np.argmin(costs))
            if costs[i] < new[j]:
                new[j], cut[j] = costs[i], i
        cuts.append(cut)
        best = new
    limits, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        if cut[j] < 0:  # this bucket is not needed
            continue
        limits.append(int(longest[j - 1]))
        j = int(cut[j])
    return limits[::-1]


def pack(df: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, block_rows: int = BLOCK_ROWS, order: tuple[Column, Column] | None = None) -> DataFrame:
    """All rows and columns of ``df`` with their place in a batch.

    Adds ``pack_tokens`` (``length``, or the words of the text and one end mark),
    ``pack_bucket`` (from 0), ``pack_limit`` (padded length), ``pack_batch`` (from 0
    in its bucket), ``pack_slot`` (from 0 in its batch). A batch of a bucket with limit
    b holds ``max(1, token_budget // b)`` rows; only the last of a bucket is shorter.

    Within a bucket rows follow the hash of their identifier or, for a stream that has
    an order, ``order``: the part of the stream (string) and the place in that part
    (integer from 0).

    A null or negative length counts as 0, a null or empty text as 1 token. A row
    longer than the budget is a batch of its own and stays whole. Equal and repeated
    rows are packed one by one. An empty table gives an empty result. Columns of ``df``
    with the added names are replaced, all others stay, whatever their names.
    """
    size = word_count(text_of(text_col)) + 1 if length is None else F.greatest(F.coalesce(length, F.lit(0)), F.lit(0))
    added = ("pack_tokens", "pack_bucket", "pack_limit", "pack_batch", "pack_slot")
    columns = [c for c in df.columns if c not in added]
    key = F.shiftrightunsigned(F.xxhash64(F.lit("pack"), F.col(id_col)), 2)
    part, place = (F.lit(""), key) if order is None else order
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), size.cast("long").alias("pack_tokens"), part.alias("part"), place.cast("long").alias("place"))
    # The sizes are counted once and kept, without the texts.
    slim = cut(rows.select("pack_tokens", "part", "place"))
    sizes = slim.groupBy("pack_tokens").count()
    cells = sizes.groupBy(length_cell(F.col("pack_tokens")).alias("cell")).agg(F.max("pack_tokens").alias("longest"), F.sum("count").alias("n"))
    limits = optimal_limits([(r.longest, r.n) for r in sorted(cells.collect())], buckets) or [0]

    def bucketed(df: DataFrame) -> DataFrame:
        bucket, limit = F.lit(len(limits) - 1), F.lit(limits[-1])
        for k in range(len(limits) - 2, -1, -1):
            bucket = F.when(F.col("pack_tokens") <= limits[k], F.lit(k)).otherwise(bucket)
            limit = F.when(F.col("pack_tokens") <= limits[k], F.lit(limits[k])).otherwise(limit)
        return df.withColumns({"pack_bucket": bucket.cast("int"), "pack_limit": limit.cast("long")})

    counts = {r.pack_bucket: r.n for r in bucketed(slim).groupBy("pack_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    if order is None:
        blocks = F.lit(1)
        for k, n in counts.items():
            blocks = F.when(F.col("pack_bucket") == k, F.lit(max(1, -(-n // block_rows)))).otherwise(blocks)
        block = F.floor(F.col("place") / F.lit(2.0**62) * blocks)
    else:
        block = F.floor(F.col("place") / F.lit(block_rows))

    def blocked(df: DataFrame) -> DataFrame:
        # The block is never null, so the join below adds no null check, which would count the words anew for each limit.
        return bucketed(df).withColumn("block", F.coalesce(block.cast("long"), F.lit(0).cast("long")))

    # Rows in earlier blocks: sums over chunks of blocks first, so that no task orders all blocks of a bucket.
    starts = blocked(slim).groupBy("pack_bucket", "part", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("chunk", F.floor(F.col("block") / 1024))
    in_chunk = Window.partitionBy("pack_bucket", "part", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_bucket = Window.partitionBy("pack_bucket").orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = starts.groupBy("pack_bucket", "part", "chunk").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(in_bucket), F.lit(0))).drop("m")
    starts = starts.withColumn("inner", F.coalesce(F.sum("n").over(in_chunk), F.lit(0))).join(chunks, ["pack_bucket", "part", "chunk"])
    starts = starts.select("pack_bucket", "part", "block", (F.col("inner") + F.col("before")).alias("start"))

    inside = Window.partitionBy("pack_bucket", "part", "block").orderBy("place", "pack_tokens")
    placed = blocked(rows).withColumn("at", F.row_number().over(inside) - 1).join(starts, ["pack_bucket", "part", "block"])
    at, per_batch = F.col("at") + F.col("start"), F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("pack_limit"), F.lit(1))))
    out = placed.withColumns({"pack_batch": F.floor(at / per_batch).cast("long"), "pack_slot": (at % per_batch).cast("long")})
    return out.select(*[F.col("row")[c].alias(c) for c in columns], *added)
