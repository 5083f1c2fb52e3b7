"""Approximate vector search: lists of vectors around centroids, and its recall.

Centroids are fitted on a bounded sample; every vector is put into the list of its
nearest centroid. A query reads the lists of its nearest centroids only, by an
equality join on the list. Reading all lists is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import settled, spread
from .search import nearest

MOST_SAMPLED = 20_000  # vectors that the centroids are fitted on
MOST_LISTS = 4096
ROUNDS = 12


@dataclass(frozen=True)
class VectorIndex:
    """``centroids`` (lists, dimensions) of unit length; ``rows``: list, doc, vector."""

    centroids: np.ndarray
    rows: DataFrame


def _units(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width): null vectors and those of another length are zeros, null components too."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    fit, out = sizes == width, np.zeros((len(column), width))
    out[fit] = flat[(np.cumsum(sizes) - sizes)[fit][:, None] + np.arange(width)]
    return np.nan_to_num(out)


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of unit vectors by rounds of assignment and mean; an empty list takes the worst fitting vector."""
    x = _units(np.nan_to_num(sample.astype(np.float64)))
    centroids = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = x @ centroids.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centroids)) == 0)
        sums[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        centroids = _units(sums)
    return centroids


def _nearest_lists(df: DataFrame, key: str, vector: str, centroids: np.ndarray, probes: int, kind: str) -> DataFrame:
    """(list, key, vector): each row once for each of its ``probes`` nearest lists."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _units(_rows(batch.column(1), centroids.shape[1])) @ centroids.T
            order = near.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(order)), order.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["list", kind, "vector"])

    plain = df.select(F.col(key).alias(kind), F.col(vector).alias("vector"))
    return plain.mapInArrow(assign, f"list int, {kind} {plain.schema[kind].dataType.simpleString()}, vector {plain.schema['vector'].dataType.simpleString()}")


def build(df: DataFrame, key: str, vector: str, lists: int | None = None, path: str | None = None) -> VectorIndex:
    """The index of all rows, some square root of their number of lists.

    The sample are the ``MOST_SAMPLED`` vectors of the smallest hashes. A null vector, or one of
    another length than most, is in the list of the zero vector; it scores 0. With a
    ``path`` the lists are stored there, one folder a list, so that a search reads only those it asks for.
    """
    spark = df.sparkSession
    total = df.count()
    lists = lists or max(1, min(MOST_LISTS, round(total**0.5)))
    sized = df.filter(F.col(vector).isNotNull())
    common = sized.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    width = common["size"] if common else 1
    sample = sized.filter(F.size(vector) == width).orderBy(F.xxhash64(key), key).limit(MOST_SAMPLED).select(vector)
    sampled = _rows(sample.toArrow().column(0).combine_chunks(), width)
    centroids = fit_centroids(sampled, lists) if len(sampled) else np.zeros((1, width))
    # A file of a hundred thousand vectors is read by one task; each of them is held against all centroids.
    rows = _nearest_lists(spread(df.select(key, vector)), key, vector, centroids, 1, "doc")
    if path is None:
        return VectorIndex(centroids, settled(rows))
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // lists)
    rows.repartition("list", F.pmod(F.xxhash64("doc"), F.lit(parts))).write.mode("overwrite").partitionBy("list").parquet(path)
    return VectorIndex(centroids, spark.read.parquet(path).select(F.col("list").cast("int"), "doc", "vector"))


def search(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
    """The k nearest vectors of each query by cosine (query, doc, score, rank) among its ``probes`` nearest lists (all: exact)."""
    if (probes or len(index.centroids)) >= len(index.centroids):
        asked = queries.select(F.lit(0).alias("list"), F.col(key).alias("query"), F.col(vector).alias("vector"))
        return nearest(index.rows.withColumn("list", F.lit(0)), asked, k)
    return nearest(index.rows, settled(_nearest_lists(queries, key, vector, index.centroids, probes, "query")), k)


def _checked(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The queries, stored, and the exact k nearest of each."""
    asked = settled(queries.select(key, vector))
    return asked, settled(search(index, asked, key, vector, k).select("query", "doc"))


def _share(index: VectorIndex, checked: tuple[DataFrame, DataFrame], key: str, vector: str, k: int, probes: int) -> float:
    asked, exact = checked
    found = search(index, asked, key, vector, k, probes).join(exact, ["query", "doc"], "left_semi").count()
    return found / max(1, exact.count())


def recall(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int, probes: int) -> float:
    """Share of the exact k nearest of all queries that the search with ``probes`` finds."""
    return _share(index, _checked(index, queries, key, vector, k), key, vector, k, probes)


def enough_probes(index: VectorIndex, queries: DataFrame, key: str, vector: str, k: int, goal: float = 0.9) -> tuple[int, float]:
    """(probes, recall): twice as many lists until the recall, measured on all queries, reaches the goal; all lists always do."""
    probes = max(1, len(index.centroids) // 8)
    checked = _checked(index, queries, key, vector, k) if probes < len(index.centroids) else None  # the exact ones are the same for all
    while probes < len(index.centroids):
        got = _share(index, checked, key, vector, k, probes)
        if got >= goal:
            return probes, got
        probes *= 2
    return len(index.centroids), 1.0


def stored(spark: SparkSession, path: str, centroids: np.ndarray) -> VectorIndex:
    """An index that ``build`` stored at ``path``."""
    return VectorIndex(centroids, spark.read.parquet(path).select(F.col("list").cast("int"), "doc", "vector"))
