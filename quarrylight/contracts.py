"""Relations that cross a stage boundary, and their checks."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import fixed


class ContractError(ValueError):
    """A relation does not satisfy its contract."""


class FetchBlocked(Exception):
    """No open-access full text could be resolved; the message lists each attempt."""


CHUNK = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("section_path", T.ArrayType(T.StringType())),
        T.StructField("parents", T.ArrayType(T.StringType())),
        T.StructField("page", T.IntegerType()),
        T.StructField("artifact_id", T.StringType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)

# Chunk lines may also carry a label under one of these keys.
CHUNK_LABELS = ("caption", "label", "title")
CHUNK_LINE = T.StructType(
    CHUNK.fields + [T.StructField(k, T.StringType()) for k in CHUNK_LABELS]
)

SIGNALS = T.StructType(
    [
        T.StructField("scan_fraction", T.DoubleType()),
        T.StructField("meta_ocr_signature", T.BooleanType()),
        T.StructField("producer", T.StringType()),
        T.StructField("creator", T.StringType()),
        T.StructField("page_labels", T.ArrayType(T.StringType())),
        T.StructField("mean_text_chars", T.DoubleType()),
        T.StructField("mean_noise_ratio", T.DoubleType()),
        T.StructField("mean_fonts", T.DoubleType()),
        T.StructField(
            "thresholds",
            T.StructType(
                [
                    T.StructField("fullpage_cov", T.DoubleType()),
                    T.StructField("text_usable", T.IntegerType()),
                    T.StructField("noise", T.DoubleType()),
                ]
            ),
        ),
    ]
)

DOCUMENT_META = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_confidence", T.DoubleType()),
        T.StructField("route", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("sha256_16", T.StringType()),
        T.StructField("n_chunks", T.IntegerType()),
        T.StructField("n_tables", T.IntegerType()),
        T.StructField("n_figures", T.IntegerType()),
        T.StructField("n_formulas", T.IntegerType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("source_signals", SIGNALS),
    ]
)

TABLES = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("page", T.IntegerType()),
            T.StructField("n_rows", T.IntegerType()),
            T.StructField("n_cols", T.IntegerType()),
            T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))),
            T.StructField("caption", T.StringType()),
        ]
    )
)
FIGURES = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("page", T.IntegerType()),
            T.StructField("bbox", T.ArrayType(T.DoubleType())),
            T.StructField("has_caption", T.BooleanType()),
            T.StructField("caption", T.StringType()),
        ]
    )
)
FORMULAS = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("page", T.IntegerType()),
            T.StructField("latex", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    )
)
SECTIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("level", T.IntegerType()),
            T.StructField("title", T.StringType()),
            T.StructField("page", T.IntegerType()),
            T.StructField("section_path", T.ArrayType(T.StringType())),
            T.StructField("body", T.StringType()),
        ]
    )
)

INTERMEDIATE_REQUIRED = ("document", "markdown", "tables", "figures", "formulas")


def validate_intermediate(doc: DataFrame | Mapping[str, Any]) -> Any:
    """Require the five columns every ingest route must deliver."""
    present = doc.columns if isinstance(doc, DataFrame) else list(doc)
    missing = [c for c in INTERMEDIATE_REQUIRED if c not in present]
    if missing:
        raise ContractError(f"intermediate lacks {missing}; present: {sorted(present)}")
    return doc


def chunk_violation() -> Column:
    """Reason a chunk row breaks its contract, null for a valid row."""
    c = F.col
    empty = lambda name: c(name).isNull() | (c(name) == "")
    return (
        F.when(c("chunk_id").isNull(), F.lit("missing chunk_id"))
        .when(c("doc_id").isNull(), F.lit("missing doc_id"))
        .when(c("kind").isNull(), F.lit("missing kind"))
        .when(~c("kind").isin(*fixed.CHUNK_KINDS), F.lit("invalid kind"))
        .when((c("kind") == "text") & empty("text"), F.lit("text chunk has no text"))
        .when((c("kind") != "text") & empty("artifact_id"), F.lit("missing artifact_id"))
    )


def audit_chunks(chunks: DataFrame) -> DataFrame:
    """Rows with a ``violation`` column, for a quarantine table."""
    return chunks.withColumn("violation", chunk_violation())


def enforce_chunks(chunks: DataFrame) -> DataFrame:
    """Fail the running job on the first invalid row.

    The check is a filter that keeps every valid row, so it also runs for a count
    or any other narrow read.
    """
    reason = chunk_violation()
    message = F.concat(
        F.lit("chunk contract: "), reason, F.lit(" in "), F.coalesce(F.col("chunk_id"), F.lit("?"))
    )
    return chunks.filter(
        F.when(reason.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    )
