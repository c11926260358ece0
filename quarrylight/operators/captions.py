"""Captions near tables and figures on the same page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import collapse_space


def nearest_captions(
    objects: DataFrame, blocks: DataFrame, pattern: str, window: float,
    above_penalty: float = 0.0, below_first: bool = False,
) -> DataFrame:
    """``(doc_id, page, object_no, caption)`` for objects with a caption in reach.

    A caption overlaps the object sideways and lies within ``window`` points above
    or below. The nearest wins, ties by block order. Blocks are reduced to caption
    lines before the join, which is an equi-join by page.
    """
    lines = blocks.select(
        "doc_id", "page", "block_no",
        F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"),
        collapse_space(F.col("text")).alias("caption"),
    ).filter(F.col("caption").rlike(pattern))
    below, above = F.col("by0") - F.col("y1"), F.col("y0") - F.col("by1")
    near_below, near_above = below.between(0, window), above.between(0, window)
    overlap = F.least("bx1", "x1") - F.greatest("bx0", "x0")
    distance = (
        F.when(near_below, below).otherwise(above + above_penalty)
        if below_first
        else F.when(near_above, above).otherwise(below)
    )
    return (
        objects.join(lines, ["doc_id", "page"])
        .filter((overlap > 0) & (near_below | near_above))
        .groupBy("doc_id", "page", "object_no")
        .agg(F.min_by("caption", F.struct(distance.alias("d"), "block_no")).alias("caption"))
    )


def figure_captions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    return nearest_captions(
        images, blocks, fixed.FIGURE_CAPTION_PATTERN, fixed.FIGURE_CAPTION_WINDOW,
        fixed.FIGURE_ABOVE_PENALTY, below_first=True,
    )


def table_captions(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    return nearest_captions(tables, blocks, fixed.TABLE_CAPTION_PATTERN, fixed.TABLE_CAPTION_WINDOW)
