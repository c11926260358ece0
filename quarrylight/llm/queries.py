"""Registered queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import table
from . import bpe, conversations, decontaminate, licenses, lines, merkle, mixing, quality, simhash, substrings, token_shards, vectors, warc


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that stand in documents."""
    return decontaminate.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of all documents with the line that stays for it."""
    return lines.fuzzy_lines(table(spark, folder, "documents"), every=True).drop("code")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses named in all documents."""
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and classes of all embeddings."""
    return vectors.linked_vectors(table(spark, folder, "embeddings"))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash classes of all documents."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all pages as read back from normalised archives."""
    index = warc.archived_pages(table(spark, folder, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that lose sentences to a span standing elsewhere before."""
    rest = substrings.remove_repeats(table(spark, folder, "documents"), ends=True).where("removed_sentences > 0")
    return rest.select(
        "doc_id", "removed_sentences", "removed_words", F.length("text").cast("long").alias("kept_chars"),
        F.md5("text").alias("kept_md5"), "source_ids",
    )


def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    plan = mixing.mix_plan(table(spark, folder, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"), columns=["doc_id"])


def op10_training_order(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of all documents in training order, as read back from their shards."""
    return token_shards.training_order(table(spark, folder, "documents"))


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and digests of all documents, encoded and decoded again."""
    return bpe.round_trip(table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations after damage."""
    return conversations.repair_report(conversations.damaged(table(spark, folder, "conversations")))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all documents, every fifth one folded from a tampered text."""
    return merkle.tampered_proofs(table(spark, folder, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_warc": op6_warc,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_quality": op9_quality,
    "op10_training_order": op10_training_order,
    "op11_bpe": op11_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}
