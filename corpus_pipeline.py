"""A training corpus from ``documents``: five stages, each one of the operators.

Every stage works on all rows that the one before kept. A stage is written as
Parquet and read again before the next one starts. Columns of the documents pass
through unchanged, also those that are named like a column an operator adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import exact, mixing, neardup, packing, toxicity
from granary.llm.common import new_folder


def _slim(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and the others in one struct that no operator looks into."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*others) if others else F.lit(0)).alias("others"))


def _whole(out: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    return out.select(*[F.col(c) if c in needed else F.col("others")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose score reaches the threshold go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.toxicity_of(docs, model) < toxicity.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one row of each group of equal texts stays."""
    return _whole(exact.deduplicate(_slim(docs, "doc_id", "text"), only_kept=True), docs, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group stays, the one with the smallest identifier."""
    gone = neardup.near_duplicates(docs).filter("not kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every document at least once, small sources in several passes, written in mixed order."""
    mixed = mixing.mix(_slim(docs, "doc_id", "text", "source"))
    ordered = mixed.repartitionByRange("mix_pos", "mix_row").sortWithinPartitions("mix_pos", "mix_row")
    return _whole(ordered, docs, "doc_id", "text", "source")


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the place of each document in a batch of its length bucket, in the order of the stream."""
    at = docs.metadataColumn("_metadata")
    return packing.pack(docs, order=(F.regexp_replace(at["file_name"], "^(part-[0-9]+)-.*(c[0-9]+)[.].*$", "$1-$2"), at["row_index"]))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_lengths),
]

# A trained model decides the first stage; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents to packed batches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
