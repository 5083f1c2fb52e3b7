"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, exact, fingerprints, licences, mixing, neardup, packing, quality, resampling, secrets, sharding, toxicity, warc
from .common import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_budget", "mix_pass", "mix_block", "mix_row", "mix_pos")


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.update_ledger(docs, new_folder(spark, "ledger")))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.judge(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    n, repeats = F.col("q_words"), F.col("q_repeat_words")
    failed = (n < 50) | (100 * repeats > 50 * n)
    return judged.select(
        "doc_id",
        n.alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & F.col("q_kept")).alias("kept"),
        F.col("q_quality").alias("quality"),
    )


def op4_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.deduplicate(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.add_score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_licence_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents")).drop("spans")


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(_table(spark, sf_dir, "documents"))


def op13_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(_table(spark, sf_dir, "embeddings"))[0]


QUERIES = {
    f.__name__: f
    for f in (
        op1_temperature_mixing,
        op2_secret_ledger,
        op3_weak_supervision,
        op4_minhash_hamming,
        op5_hilbert_shards,
        op6_content_sort,
        op7_subword_toxicity,
        op8_licence_diagonals,
        op9_length_buckets,
        op10_warc_segments,
        op11_importance_resampling,
        op12_improbable_digest,
        op13_hamerly_codes,
    )
}
