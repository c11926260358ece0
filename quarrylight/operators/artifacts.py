"""Tables, figures and formulas of documents, numbered in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed
from ..functions.text import collapse_space, is_formula
from .captions import figure_captions, table_captions
from .sections import strip


def _numbered(df: DataFrame, mark: str, *order: str) -> Column:
    n = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    return F.concat("doc_id", F.lit(f"-{mark}"), n.cast("string"))


def clean_cells(cells: Column) -> Column:
    """Cell strings on one line each, missing cells empty."""
    return F.transform(
        cells, lambda row: F.transform(row, lambda c: F.coalesce(collapse_space(c), F.lit("")))
    )


def extract_tables(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(doc_id, id, page, n_rows, n_cols, cells, caption)`` from found grids.

    ``found`` holds ``(doc_id, page, object_no, x0, y0, x1, y1, cells, n_rows, n_cols)``;
    grids without any text are dropped before numbering.
    """
    grids = found.withColumn("cells", clean_cells(F.col("cells"))).filter(
        F.exists("cells", lambda row: F.exists(row, lambda c: c != ""))
    )
    captions = table_captions(grids.select("doc_id", "page", "object_no", "x0", "y0", "x1", "y1"), blocks)
    rows = F.when(F.coalesce("n_rows", F.lit(0)) > 0, F.col("n_rows")).otherwise(F.size("cells"))
    cols = F.when(F.coalesce("n_cols", F.lit(0)) > 0, F.col("n_cols")).otherwise(
        F.array_max(F.transform("cells", lambda r: F.size(r)))
    )
    return grids.join(captions, ["doc_id", "page", "object_no"], "left").select(
        "doc_id", _numbered(grids, "t", "page", "object_no").alias("id"), "page",
        rows.cast("int").alias("n_rows"), cols.cast("int").alias("n_cols"), "cells",
        F.coalesce("caption", F.lit("")).alias("caption"),
    )


def extract_figures(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(doc_id, id, page, bbox, has_caption, caption)``; small images are dropped."""
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    kept = images.filter(area >= fixed.MIN_FIGURE_AREA)
    captions = figure_captions(kept.select("doc_id", "page", "object_no", "x0", "y0", "x1", "y1"), blocks)
    caption = F.coalesce("caption", F.lit(""))
    return kept.join(captions, ["doc_id", "page", "object_no"], "left").select(
        "doc_id", _numbered(kept, "f", "page", "object_no").alias("id"), "page",
        F.array(*[F.round(c, 2) for c in ("x0", "y0", "x1", "y1")]).alias("bbox"),
        (caption != "").alias("has_caption"), caption.alias("caption"),
    )


def extract_formulas(lines: DataFrame) -> DataFrame:
    """``(doc_id, id, page, latex, source, text)`` from ``(doc_id, page, line_no, text)``."""
    hits = lines.filter(is_formula(F.col("text")))
    return hits.select(
        "doc_id", _numbered(hits, "e", "page", "line_no").alias("id"), "page",
        F.lit("").alias("latex"), F.lit("heuristic").alias("source"), strip(F.col("text")).alias("text"),
    )


def typed_tables(items: DataFrame) -> DataFrame:
    """Tables of a typed layout: header row, then body rows; missing cells empty.

    ``items`` holds ``(doc_id, seq, page, header, rows, caption)``.
    """
    cells = F.when(F.col("header").isNotNull(), F.concat(F.array("header"), F.coalesce("rows", F.array().cast("array<array<string>>")))).otherwise(
        F.coalesce("rows", F.array().cast("array<array<string>>"))
    )
    filled = items.withColumn(
        "cells", F.transform(cells, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    )
    return filled.select(
        "doc_id", _numbered(filled, "t", "seq").alias("id"), F.coalesce("page", F.lit(1)).alias("page"),
        F.size("cells").alias("n_rows"),
        F.coalesce(F.size(F.get("cells", F.lit(0))), F.lit(0)).alias("n_cols"),
        "cells", strip(F.coalesce("caption", F.lit(""))).alias("caption"),
    )


def typed_figures(items: DataFrame) -> DataFrame:
    """Figures of a typed layout from ``(doc_id, seq, page, caption)``."""
    caption = strip(F.coalesce("caption", F.lit("")))
    return items.select(
        "doc_id", _numbered(items, "f", "seq").alias("id"), F.coalesce("page", F.lit(1)).alias("page"),
        F.lit(None).cast("array<double>").alias("bbox"), (caption != "").alias("has_caption"),
        caption.alias("caption"),
    )


def typed_formulas(blocks: DataFrame) -> DataFrame:
    """Formulas of a typed layout: blocks labelled as formula, text taken as LaTeX."""
    hits = blocks.filter(F.lower(F.coalesce("label", F.lit(""))).contains("formula"))
    latex = strip(F.coalesce("text", F.lit("")))
    return hits.select(
        "doc_id", _numbered(hits, "e", "block_no").alias("id"), F.coalesce("page", F.lit(1)).alias("page"),
        latex.alias("latex"), F.lit("docling").alias("source"), latex.alias("text"),
    )


def artifact_key(artifact_id: Column) -> Column:
    """Struct ``(doc_id, kind, number)`` of an artifact id; empty fields when it is none."""
    part = lambda k: F.regexp_extract(artifact_id, fixed.ARTIFACT_ID_PATTERN, k)
    return F.struct(part(1).alias("doc_id"), part(2).alias("kind"), part(3).alias("number"))
