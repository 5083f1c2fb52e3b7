"""Toxicity by subword-bag embeddings (operator 7).

A word is itself and its character n-grams; every piece has a vector, hashed into a
table, and a text is the mean of the vectors of all pieces of its words. A linear
softmax on that mean is trained jointly with the table, so a misspelling that was
never seen shares most of its vectors with the word it stands for.

Training reads a bounded sample of labelled rows, each reduced to hashed counts in
parallel tasks, and runs in one task; the driver sees the finished model only. As
the model is linear in the mean, a piece acts on the score through one number;
scoring ships that one table of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, new_folder, remove

# Production parameters.
THRESHOLD = 0.3
MAX_TRAINING_ROWS = 6000  # bound of the labelled sample
MAX_TRAINING_PIECES = 24_000_000  # bound of its distinct pieces, summed over rows: 8 bytes each in the training task
BUCKETS = 1 << 18
DIMENSIONS = 4
LEAST_ROWS = 3  # training rows that must hold a piece; rarer ones have no vector
GRAMS = (3, 4, 5)
_STEP = 1 << 20  # characters of a text that are looked at together, up to the end of a word
_BETWEEN = re.compile(r"\W")
_PRIME, _SCATTER = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64(64 - (BUCKETS.bit_length() - 1))


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters, digits or underscores."""
    plain = np.zeros(1 << 16, dtype=bool)
    seen = np.unique(codes)
    kind = np.array([chr(c).isalnum() or c == 95 for c in seen.tolist()], dtype=bool)
    if len(seen) and seen[-1] >= 1 << 16:
        return kind[np.searchsorted(seen, codes)]
    plain[seen] = kind
    return plain[codes]


def _scatter(h: np.ndarray) -> np.ndarray:
    """Hashes to places of the table."""
    h = (h ^ (h >> np.uint64(32))) * _SCATTER
    return ((h ^ (h >> np.uint64(29))) * _SCATTER >> _BITS).astype(np.int32)


def _places(part: str) -> np.ndarray:
    codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _letters(codes)
    letters = codes[inside].astype(np.uint64)
    if not len(letters):
        return np.empty(0, dtype=np.int32)
    starts = np.flatnonzero((inside & ~np.concatenate([[False], inside[:-1]]))[inside])
    sizes = np.diff(np.append(starts, len(letters)))
    number = np.repeat(np.arange(len(starts)), sizes)
    # All words one after another, each between a mark of its start and one of its end.
    marked = np.full(len(letters) + 2 * len(starts), ord(">"), dtype=np.uint64)
    marked[starts + 2 * np.arange(len(starts))] = ord("<")
    marked[np.arange(len(letters)) + 2 * number + 1] = letters
    word = np.repeat(np.arange(len(starts)), sizes + 2)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()) - 1, _PRIME, dtype=np.uint64)]), dtype=np.uint64)
    out = [_scatter(np.add.reduceat(letters * power[np.arange(len(letters)) - starts[number]], starts) + sizes.astype(np.uint64))]
    h = marked
    for n in range(2, max(GRAMS) + 1):
        h = h[: len(marked) - n + 1] * _PRIME + marked[n - 1 :]
        if n in GRAMS:
            out.append(_scatter(h[word[: len(h)] == word[n - 1 :]]))
    return np.concatenate(out)


def places_of(text: str) -> np.ndarray:
    """The hashed places of all pieces of all words of a text: each word, and all character
    n-grams of the word with its ends marked, as often as they occur."""
    text, at, out = text.lower(), 0, []
    while at < len(text):
        rest = _BETWEEN.search(text, at + _STEP)
        end = rest.start() if rest else len(text)
        out.append(_places(text[at:end]))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, n, places, counts): the distinct pieces of each text and how often each occurs."""
    for batch in batches:
        for k, text in enumerate(batch.column(2)):
            at, counts = np.unique(places_of(text.as_py() or ""), return_counts=True)
            columns = [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([len(at)], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "n", "places", "counts"])


@dataclass(frozen=True)
class ToxicityModel:
    """``effect[k]``: log-odds that a text made of piece k alone would add; ``base``: those of no text."""

    effect: np.ndarray
    base: float
    rows: int


def train(places: np.ndarray, shares: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 2.0, least_steps: int = 500, scale: float = 20.0, seed: int = 5) -> ToxicityModel:
    """Vectors and softmax trained together by gradient descent with momentum.

    ``places`` and ``shares`` hold the pieces of all texts end to end, ``sizes`` of them
    for each text: its distinct pieces, and their shares of all its pieces. Vectors are
    weighted by the squared inverse document frequency of their piece, so that the mean
    of a long text is not made of the commonest syllables. Plain steps matter here: rare
    pieces, each seen in a few texts, move little.
    """
    rng = np.random.default_rng(seed)
    total, positive = len(labels), int(labels.sum())
    prior = (positive + 1) / (total + 2)
    effect = np.zeros(BUCKETS, dtype=np.float32)
    if positive in (0, total):
        return ToxicityModel(effect, float(np.log(prior / (1 - prior))), total)
    held = np.bincount(places, minlength=BUCKETS)
    known = np.flatnonzero(held >= LEAST_ROWS)
    weight = np.log((total + 1) / (held[known] + 1)).astype(np.float32) ** 2
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    slot[known] = np.arange(len(known))
    ends = np.cumsum(sizes)

    table = rng.normal(0, 0.01, (len(known), DIMENSIONS)).astype(np.float32)
    head = np.full((DIMENSIONS, 2), DIMENSIONS**-0.5, dtype=np.float32)
    head[:, 0] *= -1
    bias = np.array([0.0, np.log(prior / (1 - prior))], dtype=np.float32)
    pace = [np.zeros_like(x) for x in (table, head, bias)]
    steps, step = max(least_steps, epochs * (total // batch + 1)), 0
    while step < steps:
        order = rng.permutation(total)
        for at in range(0, len(order), batch):
            chosen = []
            for i in order[at : at + batch]:
                span = slice(ends[i] - sizes[i], ends[i])
                own = slot[places[span]]
                if (own >= 0).any():
                    chosen.append((own[own >= 0], shares[span][own >= 0], labels[i]))
            if step >= steps:
                break
            step += 1
            if not chosen:
                continue
            widths = [len(p) for p, _, _ in chosen]
            place = np.concatenate([p for p, _, _ in chosen])
            share = (np.concatenate([w for _, w, _ in chosen]) * weight[place] * scale)[:, None]
            label = np.array([y for _, _, y in chosen])
            mean = np.add.reduceat(table[place] * share, np.cumsum([0, *widths[:-1]]), axis=0)
            logits = mean @ head + bias
            error = np.exp(logits - logits.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(label)), label] -= 1
            error /= len(label)
            flow = np.repeat(error @ head.T, widths, axis=0) * share
            slope = np.stack([np.bincount(place, flow[:, d], len(known)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
            now = rate * (1 - step / (steps + 1))
            for k, (x, g, r) in enumerate(((table, slope, now), (head, mean.T @ error, now / 10), (bias, error.sum(axis=0), now / 10))):
                pace[k] = 0.9 * pace[k] + 0.1 * g
                x -= r * pace[k]
    effect[known] = scale * weight * (table @ (head[:, 1] - head[:, 0]))
    return ToxicityModel(effect, float(bias[1] - bias[0]), total)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never learnt: crc32 of the identifier as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (label, places, counts), as one row."""
    places, shares, sizes, labels = [], [], [], []
    for batch in batches:
        for label, at, counts in zip(*batch.columns, strict=True):
            held = counts.values.to_numpy().astype(np.float32)
            places.append(at.values.to_numpy().copy())
            shares.append(held / max(held.sum(), 1))
            sizes.append(len(held))
            labels.append(label.as_py())
    ends = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, dtype=kind)
    model = train(ends(places, np.int32), ends(shares, np.float32), np.array(sizes, dtype=np.int64), np.array(labels, dtype=np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([model.effect.tobytes()], pa.binary()), pa.array([model.base]), pa.array([model.rows], pa.int64())], names=["effect", "base", "rows"])


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAINING_ROWS, max_pieces: int = MAX_TRAINING_PIECES) -> ToxicityModel:
    """Model from at most ``max_rows`` labelled rows with at most ``max_pieces`` distinct
    pieces in all, taken in the order of a hash of the identifier.

    A document with several labels is toxic if one of them says so; of rows with one
    identifier the smallest text is learnt. Null labels, null identifiers and held-out
    rows are not used. Without both classes the score is the share of toxic rows (one
    added to each class) for every text.
    """
    spark = df.sparkSession
    known = labels.filter(~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label")).filter("label is not null")
    order = [F.xxhash64(F.lit(3), "id"), F.col("id")]
    chosen = df.select(F.col(id_col).alias("id")).distinct().join(known, "id").orderBy(*order).limit(max_rows)
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    folder = new_folder(spark, "toxicity")
    sample = cut(texts.select("id", "label", "text").mapInArrow(featurise, f"id {kind}, label int, n long, places array<int>, counts array<int>"), folder)
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # at most max_rows rows
    bounded = sample.withColumn("so_far", F.sum("n").over(so_far)).filter(F.col("so_far") <= max_pieces).select("label", "places", "counts")
    found = bounded.mapInArrow(_train, "effect binary, base double, rows long").first()
    remove(spark, folder)
    if found is None:
        return train(*(np.empty(0, dtype=k) for k in (np.int32, np.float32, np.int64, np.int64)))
    return ToxicityModel(np.frombuffer(found.effect, dtype=np.float32), found.base, found.rows)


def text_score(text: str, effect: np.ndarray, base: float) -> float:
    """Log-odds of a text: the mean effect of all pieces of its words, over the base."""
    places = places_of(text)
    return base + (float(effect[places].mean(dtype=np.float64)) if len(places) else 0.0)


def scorer(df: DataFrame, model: ToxicityModel):
    """A column function: the toxicity (0 to 1) of a text column."""
    shared = df.sparkSession.sparkContext.broadcast((model.effect, model.base))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        effect, base = shared.value
        for texts in parts:
            out = np.array([text_score(t or "", effect, base) for t in texts], dtype=np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return score


def toxicity_of(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> Column:
    """The score of the text column of ``df``; a null text scores as an empty one."""
    return scorer(df, model)(F.coalesce(F.col(text_col), F.lit("")))


def add_score(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Null and empty texts, and texts without a word, get the score of no evidence.
    Texts are read whole, of any length; equal texts get equal scores. An empty table
    gives an empty result. Columns of ``df`` named like the added ones are replaced.
    """
    out = df.withColumn("score", toxicity_of(df, model, text_col))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
