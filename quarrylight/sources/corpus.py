"""Corpus relations derived from the plain document, label and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def doc_slug(number: str = "doc_id") -> F.Column:
    return F.concat(F.lit("d"), F.col(number).cast("string"))


def line_chunks(documents: DataFrame) -> DataFrame:
    """One text chunk per non-blank line, numbered in reading order.

    Numbering happens in the row's own array, so the relation needs no shuffle.
    """
    lines = F.filter(
        F.transform(F.split(F.col("text"), "\n"), lambda x: F.trim(x)), lambda x: x != ""
    )
    placed = documents.select(
        doc_slug().alias("doc_id"),
        F.array(F.col("lang"), F.col("source")).alias("section_path"),
        F.posexplode_outer(lines).alias("pos", "text"),
    ).filter(F.col("text").isNotNull())
    return placed.select(
        F.concat(F.col("doc_id"), F.lit("-c"), (F.col("pos") + 1).cast("string")).alias("chunk_id"),
        "doc_id",
        "text",
        F.lit("text").alias("kind"),
        "section_path",
        F.array().cast("array<string>").alias("parents"),
        F.lit(1).alias("page"),
        F.lit(None).cast("string").alias("artifact_id"),
        F.lit(None).cast("string").alias("group_id"),
        F.lit(None).cast("string").alias("role"),
    )


def label_sources(labels: DataFrame) -> DataFrame:
    """Document class from the quality label: 1 is native, 0 is scan."""
    return labels.select(
        doc_slug().alias("doc_id"),
        F.when(F.col("quality") == 1, F.lit("native"))
        .when(F.col("quality") == 0, F.lit("scan"))
        .otherwise(F.lit("unknown"))
        .alias("doc_class"),
    )


def benchmark_queries(benchmark: DataFrame) -> DataFrame:
    """Every benchmark passage as one query, text taken whole."""
    return benchmark.select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"),
        F.col("text").alias("question"),
    )


def conversation_queries(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.concat_ws("-", F.lit("v"), F.col("conv_id").cast("string"),
                    F.col("turn").cast("string")).alias("query_id"),
        F.col("text").alias("question"),
    )
