"""Chunk files as a stream: the scan and contract of the index build, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..contracts import CHUNK, CHUNK_LINE, audit_chunks
from ..sources.products import indexable_text, parsed_lines


def chunk_stream(spark: SparkSession, outputs: str, files_per_trigger: int = 1000) -> DataFrame:
    """Chunk rows of product folders as they appear, with their contract violation."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(f"{outputs}/*/chunks.jsonl")
    raw = parsed_lines(lines, CHUNK_LINE).filter("NOT _malformed").drop("value", "_malformed")
    return audit_chunks(raw).select(
        *[indexable_text().alias("text") if n == "text" else F.col(n) for n in CHUNK.fieldNames()], "violation"
    )


def land_chunks(chunks: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append to a table split by validity; the file sink's log makes a repeated batch harmless.

    ``<table>/valid=true`` is the input of an index build, the rest is quarantine.
    """
    return (
        chunks.withColumn("valid", F.col("violation").isNull())
        .writeStream.format("parquet")
        .partitionBy("valid")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def landed_chunks(spark: SparkSession, table: str) -> DataFrame:
    """Valid chunks landed so far."""
    return spark.read.parquet(table).filter("violation IS NULL").select(*CHUNK.fieldNames())
