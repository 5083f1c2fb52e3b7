"""Document fingerprints from improbable features (operator 12).

Every window of bytes has an entropy, and a window is the more telling the rarer its
entropy is among all windows of all documents. In each run of neighbouring windows the
rarest is voted for; windows with enough votes are the features of a text. Features go
into a chain of Bloom filters of fixed size, and two fingerprints are compared by
the bits their filters share, less those that chance would share.

Entropies, votes and hashes are computed over the bytes of many texts at once, with
whole numbers, so that equal texts have equal fingerprints wherever they stand. The
next document is found without sorting all rows in one task: identifiers are cut into
ranges, and the first row of a range is also sent to the end of the range before.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import STEP, slices, text_bytes
from .common import heavy_values, partitions

# Production parameters.
WINDOW = 32  # bytes of a window, and windows of a run
VOTES = 8  # runs whose rarest window a feature is, at least
LEVELS = 500  # steps of the entropy
FILTER_BITS = 2048
FILTER_FEATURES = 160  # features in one filter
HASHES = 5
_BLOCK = 1 << 17  # bytes whose equal neighbours are counted together
_UNIT = 1 << 20

# c * log2(c) in whole units, and what the c-th equal byte adds to it.
_SUM = np.array([0, *[round(_UNIT * c * np.log2(c)) for c in range(1, WINDOW + 1)]], dtype=np.int64)
_STEP_UP = np.diff(_SUM, prepend=0)
_TOP = int(_SUM[WINDOW])  # that of a window of one byte; entropy 0


def _equal_neighbours(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the WINDOW - 1 bytes before, and after, equal each byte; plus 1."""
    back, ahead = np.ones(len(data), dtype=np.uint8), np.ones(len(data), dtype=np.uint8)
    for at in range(0, len(data), _BLOCK):
        end = min(at + _BLOCK, len(data))
        for d in range(1, WINDOW):
            stop = min(end, len(data) - d)
            if stop > at:
                same = (data[at:stop] == data[at + d : stop + d]).view(np.uint8)
                ahead[at:stop] += same
                back[at + d : stop + d] += same
    return back, ahead


def window_levels(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of WINDOW bytes, from 0 to LEVELS; windows are moved byte by byte."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    back, ahead = _equal_neighbours(data)
    # Moving a window takes its first byte out (``ahead`` counts it there) and a new one in.
    change = _STEP_UP[back[WINDOW:]] - _STEP_UP[ahead[: n - 1]]
    first = int(_SUM[np.bincount(data[:WINDOW], minlength=256)].sum())
    total = np.cumsum(np.concatenate([[first], change]))
    return (_TOP - total) * LEVELS // _TOP


def _inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` windows lie in one text."""
    borders = np.zeros(n + WINDOW, dtype=np.int32)
    np.add.at(borders, offsets[1:-1], 1)
    passed = np.cumsum(borders)
    return passed[:n] == passed[WINDOW - 1 : n + WINDOW - 1]


def level_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows of all texts have each level; each task sums its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, dtype=np.int64)
        for batch in slices(batches, 0):
            data, offsets = text_bytes(batch.column(0))
            levels = window_levels(data)
            total += np.bincount(levels[_inside(offsets, len(levels))], minlength=LEVELS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1, dtype=np.int32)), pa.array(total)], names=["level", "n"])

    out = np.zeros(LEVELS + 1, dtype=np.int64)
    for level, n in df.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n")).collect():
        out[level] = n
    return out


def level_ranks(counts: np.ndarray) -> np.ndarray:
    """Place of each level from the rarest, which is 0, to the most frequent; ties by level."""
    ranks = np.empty(len(counts), dtype=np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    return ranks


def _mixed(windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of WINDOW bytes."""
    h = np.zeros(len(windows), dtype=np.uint64)
    for word in np.ascontiguousarray(windows).view("<u8").T:
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def features(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the features of all texts, by text and place.

    A window is a feature if it is the leftmost rarest of at least VOTES of the runs of
    WINDOW windows that hold it, or the leftmost one with the most votes of its text. Runs
    end with their text. A text shorter than a window is one feature, an empty one has none.
    """
    sizes = np.diff(offsets)
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    padded = np.zeros((len(short), WINDOW), dtype=np.uint8)
    for row, k in enumerate(short.tolist()):
        padded[row, : sizes[k]] = data[offsets[k] : offsets[k + 1]]
    n = max(0, len(data) - WINDOW + 1)
    texts, hashes = [short], [_mixed(padded)]
    if n:
        valid = _inside(offsets, n)
        bits = max(1, n.bit_length())
        # Windows over a border come last; there are WINDOW - 1 of them at each, so no run passes one.
        key = np.where(valid, ranks[window_levels(data)], len(ranks))
        key = np.concatenate([(key << bits) | np.arange(n), np.full(WINDOW - 1, np.iinfo(np.int64).max)])
        width = 1
        while width < WINDOW:  # smallest of 2, 4, 8 ... neighbours
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        votes = np.bincount(key[:n][valid] & ((1 << bits) - 1), minlength=n)
        at = np.flatnonzero(votes)
        of, count = np.searchsorted(offsets, at, "right") - 1, votes[at]
        most = np.zeros(len(sizes), dtype=np.int64)
        np.maximum.at(most, of, count)
        top = np.flatnonzero(count == most[of])
        chosen = count >= VOTES
        chosen[top[np.unique(of[top], return_index=True)[1]]] = True
        at = at[chosen]
        texts.append(of[chosen])
        hashes.append(_mixed(data[at[:, None] + np.arange(WINDOW)]))
    text, h = np.concatenate(texts), np.concatenate(hashes)
    order = np.argsort(text, kind="stable")
    return text[order], h[order]


class Fingerprints:
    """Chains of Bloom filters of several texts: ``filters`` (n, bytes), those of text k from
    ``start[k]`` to ``start[k + 1]``, with ``held`` features each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray):
        text, h = features(data, offsets, ranks)
        # A feature counts once in a text, where it comes first.
        order = np.lexsort((np.arange(len(h)), h, text))
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (text[order][1:] != text[order][:-1]) | (h[order][1:] != h[order][:-1])
        keep = np.sort(order[fresh])
        text, h = text[keep], h[keep]
        texts = len(offsets) - 1
        per = np.bincount(text, minlength=texts)
        ordinal = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        self.start = np.concatenate([[0], np.cumsum(-(-per // FILTER_FEATURES))])
        number = self.start[text] + ordinal // FILTER_FEATURES
        self.held = np.bincount(number, minlength=int(self.start[-1]))
        bits = np.zeros((int(self.start[-1]), FILTER_BITS), dtype=bool)
        for k in range(HASHES):
            bits[number, (h >> np.uint64(11 * k)).astype(np.int64) % FILTER_BITS] = True
        self.filters = np.packbits(bits, axis=1)

    def chain(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(int(self.start[k]), int(self.start[k + 1]))
        return self.filters[at], self.held[at]

    def text(self, k: int) -> str:
        """The fingerprint: features and filter in base 64, for each filter."""
        return ",".join(f"{n}:{base64.b64encode(x.tobytes()).decode()}" for x, n in zip(*self.chain(k), strict=True))


def parsed(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The filters of a fingerprint and the features they hold."""
    pieces = [p.split(":") for p in fingerprint.split(",")] if fingerprint else []
    filters = np.frombuffer(b"".join(base64.b64decode(x) for _, x in pieces), dtype=np.uint8).reshape(len(pieces), FILTER_BITS // 8)
    return filters, np.array([int(n) for n, _ in pieces], dtype=np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """From 0 to 1: each filter of the shorter chain against the one of the other that is most like
    it, weighed by its features.

    Two filters are alike by the bits both have, where what chance would share is 0 and
    all bits of the smaller one are 1. Equal chains, two empty ones too, are 1; an
    empty one is 0 to any other. Bits are compared a filter at a time, in memory of one chain.
    """
    if a[0].shape == b[0].shape and np.array_equal(a[0], b[0]):
        return 1.0
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if (len(a[0]), int(a[1].sum())) > (len(b[0]), int(b[1].sum())):
        a, b = b, a
    sizes = np.bitwise_count(b[0]).sum(axis=1, dtype=np.int64)
    total = 0.0
    for x, n in zip(*a, strict=True):
        own = int(np.bitwise_count(x).sum())
        both = np.bitwise_count(x & b[0]).sum(axis=1, dtype=np.int64)
        chance = own * sizes / FILTER_BITS
        total += int(n) * float(((both - chance) / np.maximum(np.minimum(own, sizes) - chance, 1e-9)).max())
    return min(1.0, max(0.0, total / int(a[1].sum())))


def add_fingerprint(df: DataFrame, ranks: np.ndarray, text_col: str = "text") -> DataFrame:
    """``df`` with the column ``fingerprint`` of its text, null as empty; a column of that name is replaced."""
    others = [c for c in df.columns if c != "fingerprint"]
    at = others.index(text_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = Fingerprints(*text_bytes(batch.column(at)), ranks)
            marks = pa.array([found.text(k) for k in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], schema=batch.schema.append(pa.field("fingerprint", pa.string())))

    schema = T.StructType([*[df.schema[c] for c in others], T.StructField("fingerprint", T.StringType())])
    return df.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(mark, schema)


@F.pandas_udf(T.DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two columns of fingerprints; null is an empty one."""
    return pd.Series([likeness(parsed(x or ""), parsed(y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters from the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranged(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with ``part`` and ``guest``: rows of a part are neighbours in the order of
    (id, hash of the text), null identifiers last; the first row of each part is also a guest at the
    end of the part before it, and that of the first part at the end of the last.

    Parts are ranges of identifiers between quantiles, and an identifier that holds a
    large share of the rows is dealt into parts by the hash. The driver holds one
    identifier and one hash for each part: a few times the number of partitions.
    """
    n = partitions(rows.sparkSession)
    keyed = rows.withColumn("key", F.xxhash64("text"))
    ids = rows.select("id")
    quantiles = ids.agg(F.percentile_approx("id", F.array(*[F.lit(k / (2 * n)) for k in range(1, 2 * n)]), F.lit(20 * n))).first()[0] or []
    hot = dict(heavy_values(ids, "id"))
    ends = sorted({*quantiles, *[x for x in hot if x is not None]})
    array = F.array(*[F.lit(x) for x in ends]).cast(f"array<{rows.schema['id'].dataType.simpleString()}>")
    # Two cells for each end: ids below it, and the end itself; then those above the last, and null.
    below = F.size(F.filter(array, lambda e: e < F.col("id")))
    cell = F.when(F.col("id").isNull(), F.lit(2 * len(ends) + 1)).otherwise(2 * below + F.array_contains(array, F.col("id")).cast("int"))
    share = F.lit(1)
    for value, parts in hot.items():
        same = F.col("id").isNull() if value is None else F.col("id") == F.lit(value)
        share = F.when(same, F.lit(parts)).otherwise(share)
    deal = F.least(F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * share), share - 1)
    placed = keyed.withColumn("part", cell.cast("long") * (1 << 32) + deal)
    firsts = placed.groupBy("part").agg(F.min(F.struct(F.coalesce("id", F.lit(0)).alias("id"), "key")).alias("first")).orderBy("part").collect()
    before = [(r.part, r["first"]["id"], r["first"]["key"], firsts[k - 1].part) for k, r in enumerate(firsts)]
    known = rows.sparkSession.createDataFrame(before, f"part long, first_id {rows.schema['id'].dataType.simpleString()}, first_key long, back long")
    leads = (F.coalesce("id", F.lit(0)) == F.col("first_id")) & (F.col("key") == F.col("first_key"))
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    both = F.when(leads, F.array(own, F.struct(F.col("back").alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    each = placed.join(F.broadcast(known), "part").select("id", "text", "key", F.explode(both).alias("to"))
    return each.select("id", "text", "key", F.col("to.part").alias("part"), F.col("to.guest").alias("guest"))


def edited_likeness(df: DataFrame, ranks: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: identifier, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.

    The edited text has its last floor(n_chars / 2) characters replaced by as many (or
    all) first ones of the next document by identifier; the last is followed by the first. Rows of one
    identifier follow each other by the hash of their text, null identifiers come last. A
    null text is empty: no features, an empty fingerprint, likeness 1 to an empty one and
    0 to others. Repeated rows get a row each, and follow each other. An
    empty table gives an empty result. Identifiers are whole numbers; other columns are not
    used, so their names cannot clash. Without ``ranks`` they are learned from ``df``.

    Whole texts are shuffled once. A task streams its rows and holds a few megabytes of
    text, or one longer text.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    ranks = level_ranks(level_counts(rows)) if ranks is None else ranks
    fields = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next one is in the following slice
        for batch in slices(batches, 1, STEP // 2):
            part, guest, texts, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(1).to_pylist(), batch.column(0)
            if held is not None:
                ids = pa.concat_arrays([held[0], ids])
                part, guest, texts = [held[1], *part], [held[2], *guest], [held[3], *texts]
            held = (ids.slice(len(ids) - 1, 1), part[-1], guest[-1], texts[-1])
            pairs = [k for k in range(len(texts) - 1) if not guest[k] and part[k] == part[k + 1]]
            if not pairs:
                continue
            own = Fingerprints(*bytes_of(texts), ranks)
            changed = [edited(texts[k], texts[k + 1]) for k in pairs]
            after = Fingerprints(*bytes_of(changed), ranks)
            columns = [
                [len(texts[k]) for k in pairs],
                [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                [own.text(k) for k in pairs],
                [after.text(j) for j in range(len(pairs))],
                [likeness(own.chain(k), after.chain(j)) for j, k in enumerate(pairs)],
                [likeness(own.chain(k), own.chain(k + 1)) for k in pairs],
            ]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs)), *[pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]], names=["id", *[f for f, _ in fields]])

    n = partitions(df.sparkSession)
    dealt = _ranged(rows).repartition(n, "part").sortWithinPartitions("part", "guest", F.col("id").asc_nulls_last(), "key")
    kind = rows.schema["id"].dataType.simpleString()
    out = dealt.select("id", "text", "part", "guest").mapInArrow(compare, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
