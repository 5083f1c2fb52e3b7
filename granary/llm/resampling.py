"""Importance resampling towards a target (operator 11).

Texts are bags of word runs, hashed into buckets. The share of a bucket in the target
over its share in the documents is the gain of its features; a document weighs the sum
of its gains, and the documents are drawn without replacement by the Gumbel top-k
trick with noise from a hash of the identifier.

Features are made from the bytes of an Arrow batch: a table classifies and lower-cases
bytes, differences of the classes are the borders of words, and the CRC registers of
all words advance together, one byte at a time, by a table. Counts of buckets are
summed by Spark; the driver holds two numbers for each bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import STEP, slices, text_bytes
from .common import cut, partitions

# Production parameters.
RUN = 1  # longest run of words that is a feature
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
ADDED = ("n_features", "weight", "score", "rank")
FEW = 64  # registers that are left when the rest of their words is fed at once
_WORDS = 1 << 20  # words whose registers advance together
_ALL = np.uint32(0xFFFFFFFF)

_codes = np.arange(256)
_LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)
_IN_WORD = ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80)


def _crc_table() -> np.ndarray:
    """The register after each byte, for the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and size of every word; a word ends where its text ends."""
    starts, ends = [], []
    before = False
    for at in range(0, len(data), STEP):
        inside = _IN_WORD[data[at : at + STEP]]
        change = np.diff(inside.view(np.int8), prepend=np.int8(before))
        starts.append(np.flatnonzero(change == 1) + at)
        ends.append(np.flatnonzero(change == -1) + at)
        before = bool(inside[-1])
    borders = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    borders = borders[_IN_WORD[data[borders - 1]] & _IN_WORD[data[borders]]]
    last = np.array([len(data)] if before else [], dtype=np.int64)
    first = np.sort(np.concatenate([*starts, borders]).astype(np.int64), kind="stable")
    end = np.sort(np.concatenate([*ends, borders, last]).astype(np.int64), kind="stable")
    return first, end - first


def advance(registers: np.ndarray, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC registers after ``sizes`` bytes from ``first`` each, all of them one byte at a step."""
    order = np.argsort(sizes.max(initial=0) - sizes, kind="stable")
    left = sizes[order]
    out, at, k = registers[order], first[order], 0
    while (alive := int(np.searchsorted(-left, -k, "left"))) > FEW:
        part = out[:alive]
        out[:alive] = (part >> np.uint32(8)) ^ _TABLE[(part ^ data[at[:alive] + k]) & np.uint32(255)]
        k += 1
    for j in range(alive):  # the few longest words, from byte k on
        out[j] = np.uint32(zlib.crc32(data[at[j] + k : at[j] + left[j]].tobytes(), int(out[j] ^ _ALL))) ^ _ALL
    back = np.empty_like(out)
    back[order] = out
    return back


def features(data: np.ndarray, offsets: np.ndarray, run: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, crc) of all runs of 1 to ``run`` words of the texts: arrays, in parts."""
    data = _LOWER[data]
    first, sizes = word_bounds(data, offsets)
    text = np.searchsorted(offsets, first, "right") - 1
    space = np.frombuffer(b" ", dtype=np.uint8)
    for at in range(0, len(first), _WORDS):
        word = np.arange(at, min(at + _WORDS, len(first)))
        registers = np.full(len(word), _ALL, dtype=np.uint32)
        for n in range(run):
            if n:
                inside = word + n < len(first)
                inside[inside] = text[word[inside]] == text[word[inside] + n]
                word, registers = word[inside], registers[inside]
                registers = (registers >> np.uint32(8)) ^ _TABLE[(registers ^ space) & np.uint32(255)]
            registers = advance(registers, data, first[word + n], sizes[word + n])
            yield text[word], registers ^ _ALL


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How often each bucket is hit in all texts of ``df``; each task sums its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, 0):
            for _, crc in features(*text_bytes(batch.column(0)), run):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    parts = df.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed share in the target over that in the documents), for each bucket."""
    buckets, of_documents, of_target = len(documents), int(documents.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((float(t) + 1) * (of_documents + buckets) / ((float(s) + 1) * (of_target + buckets)))) for s, t in zip(documents.tolist(), target.tolist(), strict=True)],
        dtype=np.int64,
    )


def gumbel_noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) of an identifier; null is read as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def add_weight(df: DataFrame, gains: np.ndarray, text_col: str = "text", run: int = RUN) -> DataFrame:
    """The other columns of ``df`` with ``n_features``, ``weight`` and ``_words`` of the text."""
    others = [c for c in df.columns if c != text_col]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            n = batch.num_rows
            count, weight, words = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), None
            for text, crc in features(*text_bytes(batch.column(0)), run):
                count += np.bincount(text, minlength=n)
                np.add.at(weight, text, gains[crc % np.uint32(len(gains))])
            if run == 1:
                words = count
            else:
                data, offsets = text_bytes(batch.column(0))
                words = np.bincount(np.searchsorted(offsets, word_bounds(data, offsets)[0], "right") - 1, minlength=n)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(count), pa.array(weight), pa.array(words)], schema=pa.schema([*list(batch.schema)[1:], pa.field("n_features", pa.int64()), pa.field("weight", pa.int64()), pa.field("_words", pa.int64())]))

    schema = T.StructType([*[df.schema[c] for c in others], *[T.StructField(c, T.LongType()) for c in ("n_features", "weight", "_words")]])
    return df.select(F.col(f"`{text_col}`").cast("string").alias(text_col), *[F.col(f"`{c}`") for c in others]).mapInArrow(weigh, schema)


def resample(
    df: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, run: int = RUN, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """One row for each row of ``df``: identifier, ``n_features``, ``weight``, ``score`` and
    ``rank`` in the draw towards the texts of ``target`` (column ``text_col``); undrawn null.

    Of N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn, by
    score, then smaller identifier (null last). A null text has no words: weight 0. A null
    identifier has the noise of an empty one. Repeated rows count and rank each for itself.
    An empty table gives an empty result; an empty target lowers common buckets. Other
    columns are not used, so their names cannot clash.

    Rows are ranked by ranges of (score, identifier): a range numbers its rows, and the
    counts of earlier ranges, one number each, are added.
    """
    gains = bucket_gains(bucket_counts(df, text_col, buckets, run), bucket_counts(target, text_col, buckets, run))
    rows = df.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id"))
    scored = add_weight(rows, gains, "text", run).withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), seed))
    # Written before it is ranged: ranges are sampled, and equal rows are told apart by a stored number.
    table = cut(scored.withColumn("able", F.col("_words") >= least_words).drop("_words").withColumn("row", F.monotonically_increasing_id()))
    order = [F.col("able").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    ranged = table.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    ranged = cut(ranged.drop("row").withColumn("at", F.monotonically_increasing_id()))
    place = F.expr("shiftright(at, 33)")
    counts = ranged.filter("able").groupBy(place.cast("int").alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # one row for each partition
    quota, starts, total = 0, [], 0
    for number, n in counts:
        starts.append((number, total))
        total += n
    quota = percent * total // 100
    known = df.sparkSession.createDataFrame(starts, "range int, start long")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = ranged.withColumn("range", place.cast("int")).join(F.broadcast(known), "range", "left")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("able") & (rank <= quota), rank).alias("rank"))


def draw(df: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``df`` with all their columns; identifiers must be unique and not null."""
    chosen = resample(df, target, id_col=id_col, **options).filter(F.col("rank").isNotNull()).select(id_col)
    return df.join(chosen, id_col, "left_semi")
