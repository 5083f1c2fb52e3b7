"""Vector codes by product quantisation (operator 13).

Components become whole numbers, vectors are cut into parts, and each part position has
a codebook from Lloyd rounds. The rounds are Hamerly's: a part keeps an upper bound of
the distance to its own entry and one lower bound of the distance to any other. When
entries move, the bounds move with them; only where the upper bound is not strictly
below the lower one (equal is a possible tie) the entries are scanned in whole numbers,
so ties go to the lower index as in the plain rounds.

Each round is one pass over a table of vectors, codes and bounds in the shared folder
and writes the next one, so a lost executor costs the tasks it ran. Every task adds the
sums of its entries to that table; Spark sums them, and the driver holds the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_folder, remove, spread_join

# Production parameters.
PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
MOST_LABELS = 100_000  # labels whose sums are broadcast; more are joined by key


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) of whole vectors to the entries of a codebook."""
    return np.stack([np.einsum("ij,ij->i", x - c, x - c) for c in book], axis=1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, upper and lower bound from all entries; ties go to the lower index."""
    d = squared(x, book)
    code = d.argmin(axis=1)
    own = d[np.arange(len(x)), code]
    d[np.arange(len(x)), code] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(axis=1)) if len(book) > 1 else np.full(len(x), np.inf)
    return code, _up(np.sqrt(own)), _down(other)


@dataclass(frozen=True)
class Move:
    """Codebook of a part before and after an update, and what follows for the bounds."""

    book: np.ndarray
    drift: np.ndarray  # way of each entry
    others: np.ndarray  # longest way of any other entry
    half: np.ndarray  # half the distance to the nearest other entry


def moved(old: np.ndarray, new: np.ndarray) -> Move:
    drift = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-12)
    others, half = np.zeros(len(new)), np.full(len(new), np.inf)
    for e in range(len(new)):
        rest = np.delete(np.arange(len(new)), e)
        if len(rest):
            others[e] = drift[rest].max()
            half[e] = np.sqrt(float(((new[rest] - new[e]) ** 2).sum(axis=1).min())) / 2 * (1 - 1e-12)
    return Move(new, drift, others, half)


def reassign(x: np.ndarray, move: Move, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Code and bounds of one part of all rows after a move, and how many rows were scanned."""
    upper = _up(upper.astype(np.float64) + move.drift[code])
    lower = _down(lower.astype(np.float64) - move.others[code])
    wall = np.maximum(lower, move.half[code])
    near = np.flatnonzero(upper >= wall)
    if len(near):
        gap = x[near] - move.book[code[near]]
        upper[near] = _up(np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        near = near[upper[near] >= wall[near]]
    code = code.copy()
    if len(near):
        code[near], upper[near], lower[near] = scan(x[near], move.book)
    return code, upper, lower, len(near)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


_STATE = "codes array<tinyint>, upper array<float>, lower array<float>, part int, entry int, n long, sums array<bigint>"
_STATE_FIELDS = [("codes", pa.list_(pa.int8())), ("upper", pa.list_(pa.float32())), ("lower", pa.list_(pa.float32())), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]


def _round(table: DataFrame, moves: list[Move], width: int, first: bool) -> DataFrame:
    """One assignment of all rows of ``table`` (row, v, and after the first the state), with
    a row of sums for each part and entry from each task."""
    parts = len(moves)
    fields = [table.schema["row"], table.schema["v"]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = len(moves[0].book)
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        schema = None
        for batch in batches:
            x = _matrix(batch.column(1), parts * width, np.int64).reshape(-1, parts, width)
            codes, upper, lower = np.zeros((len(x), parts), np.int8), np.zeros((len(x), parts), np.float32), np.zeros((len(x), parts), np.float32)
            if not first:
                held = _matrix(batch.column(2), parts, np.int64), _matrix(batch.column(3), parts, np.float32), _matrix(batch.column(4), parts, np.float32)
            for p, move in enumerate(moves):
                own = np.ascontiguousarray(x[:, p])
                if first:
                    code, upper[:, p], lower[:, p] = scan(own, move.book)
                else:
                    code, upper[:, p], lower[:, p], _ = reassign(own, move, *(h[:, p].copy() for h in held))
                codes[:, p] = code
                counts[p] += np.bincount(code, minlength=entries)
                np.add.at(sums[p], code, own)
            none = [pa.nulls(len(x), t) for _, t in _STATE_FIELDS[3:]]
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), *[pa.field(*f) for f in _STATE_FIELDS]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(codes, pa.int8()), _lists(upper, pa.float32()), _lists(lower, pa.float32()), *none], schema=schema)
        if schema is not None:
            n = parts * entries
            part, entry = np.divmod(np.arange(n, dtype=np.int32), np.int32(entries))
            yield pa.RecordBatch.from_arrays(
                [*[pa.nulls(n, schema.field(k).type) for k in range(5)], pa.array(part), pa.array(entry), pa.array(counts.ravel()), _lists(sums.reshape(n, width), pa.int64())], schema=schema
            )

    held = table.select("row", "v") if first else table.filter("part is null").select("row", "v", "codes", "upper", "lower")
    row, v = (f.dataType.simpleString() for f in fields)
    return held.mapInArrow(assign, f"row {row}, v {v}, {_STATE}")


def _updated(table: DataFrame, moves: list[Move], width: int) -> list[Move]:
    """The moves to the means of what each entry holds, rounded down; an entry without a part stays."""
    sums = table.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
    books = [m.book.copy() for m in moves]
    for r in sums.collect():  # parts * entries rows
        if r.n:
            books[r.part][r.entry] = [r[f"s{k}"] // r.n for k in range(width)]
    return [moved(m.book, book) for m, book in zip(moves, books, strict=True)]


def whole_vectors(df: DataFrame, vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows of ``df`` whose vector and all its components are there and finite, with ``v``: floor(scale * x)."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    real = F.forall(F.col(f"`{vec_col}`"), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = df.filter(F.col(f"`{vec_col}`").isNotNull() & F.coalesce(real, F.lit(False)))
    return kept.withColumn("v", F.transform(x, lambda c: F.floor(c * scale).cast("long")))


def encode(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, list[np.ndarray]]:
    """(codes, codebooks): for each kept row the identifier, ``code`` (two hex digits a part),
    ``error`` (squared distances to the final entries, summed over parts), ``label_error``
    (sum of error over rows with an equal label, null labels together) and
    ``codebooks_sha256``; and the final codebook of each part position.

    Rows whose vector is null or has a null or non-finite component are dropped, as are
    vectors of another length than the most frequent multiple of ``parts`` (ties: the longest),
    empty ones included. Codebooks start from the ``entries`` smallest identifiers; of rows
    that share one the smallest vector counts, and null identifiers start none. With fewer
    identifiers there are fewer entries, with none the result is empty. Repeated rows are coded each. Other
    columns are not used, so their names cannot clash. Components too large for exact
    64-bit squares are refused with a ValueError.
    """
    if entries > 128:
        raise ValueError("a code holds at most 128 entries")
    spark = df.sparkSession
    row = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
    rows = whole_vectors(df.select(row.alias("row"), F.col(f"`{vec_col}`").alias("x")), "x").select("row", "v")
    lengths = rows.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"))
    length = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    empty = spark.createDataFrame([], f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    if length is None:
        return empty, []
    width = length["size"] // parts
    if length["size"] * (2 * length["most"]) ** 2 >= 1 << 63:
        raise ValueError("components are too large for exact distances")
    rows = rows.filter(F.size("v") == length["size"])
    starts = [r.v for r in rows.filter("row.id is not null").groupBy("row.id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()]
    if not starts:
        return empty, []
    begin = np.array(starts, dtype=np.int64).reshape(len(starts), parts, width)
    moves = [moved(begin[:, p], begin[:, p]) for p in range(parts)]

    path = new_folder(spark, "codes")
    table = cut(_round(rows, moves, width, True), path)
    for _ in range(rounds):
        moves = _updated(table, moves, width)
        old, path = path, new_folder(spark, "codes")
        table = cut(_round(table, moves, width, False), path)
        remove(spark, old)
    books = [m.book for m in moves]
    digest = hashlib.sha256(",".join(str(int(c)) for book in books for entry in book for c in entry).encode()).hexdigest()

    coded = _coded(table, books, width)
    key = F.when(F.col("row.label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("row.label").cast("string")))
    coded = cut(coded.withColumn("_label", key))
    remove(spark, path)
    sums = cut(coded.groupBy("_label").agg(F.sum("error").alias("label_error")))
    few = sums.count() <= MOST_LABELS
    out = coded.join(F.broadcast(sums), "_label") if few else spread_join(coded, sums, "_label", F.col("row.id"))
    return out.select(F.col("row.id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books


def _coded(table: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(row, code, error): the codes as digits, and the squared distances to their entries, summed over parts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(books) * width, np.int64).reshape(-1, len(books), width)
            codes = _matrix(batch.column(2), len(books), np.int64)
            gaps = x - np.stack(books)[np.arange(len(books)), codes]
            digits = codes.astype(np.uint8).tobytes().hex()
            code = [digits[k : k + 2 * len(books)] for k in range(0, len(digits), 2 * len(books))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.string()), pa.array((gaps * gaps).sum(axis=(1, 2)))], schema=pa.schema([batch.schema.field(0), pa.field("code", pa.string()), pa.field("error", pa.int64())]))

    held = table.filter("part is null").select("row", "v", "codes")
    return held.mapInArrow(write, f"row {table.schema['row'].dataType.simpleString()}, code string, error long")


def decode(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``coded`` with ``vector``: the entries its codes stand for, as real numbers."""
    flat = F.array(*[F.lit(int(c)) for c in np.stack(books).ravel()]).cast("array<bigint>")
    entries, width = books[0].shape
    at = F.sequence(F.lit(0), F.lit(len(books) * width - 1))

    def one(k: Column) -> Column:
        p = F.floor(k / width).cast("int")
        entry = F.conv(F.substring(F.col("code"), p * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.get(flat, (p * entries + entry) * width + k % width) / scale

    return coded.withColumn("vector", F.transform(at, one))
