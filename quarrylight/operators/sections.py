"""Blocks to headings, sections and markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MAX_HEADING_CHARS = 120
MAX_BOLD_CHARS = 80
LEAN_LEVELS = 3
# Labels whose text belongs to a section body in typed layouts.
BODY_LABELS = ("text", "paragraph", "list_item", "caption", "code", "footnote")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def body_size(blocks: DataFrame) -> DataFrame:
    """``(doc_id, body_size)``: the most common block size, ties by first block."""
    sizes = blocks.groupBy("doc_id", "size").agg(
        F.count("*").alias("n"), F.min("block_no").alias("first")
    )
    return sizes.groupBy("doc_id").agg(
        F.min_by("size", F.struct((-F.col("n")).alias("neg"), "first")).alias("body_size")
    )


def heading_levels(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """``(doc_id, size, size_level)``: sizes above the body, largest first, capped at three."""
    bigger = (
        blocks.select("doc_id", "size").distinct().join(body, "doc_id")
        .filter(F.col("size") > F.col("body_size") + 0.5)
    )
    order = W.partitionBy("doc_id").orderBy(F.desc("size"))
    return bigger.select(
        "doc_id", "size", F.least(F.dense_rank().over(order), F.lit(LEAN_LEVELS)).alias("size_level")
    )


def mark_headings(blocks: DataFrame) -> DataFrame:
    """Add ``heading``: 1..3 for a heading, 0 for body text."""
    body = body_size(blocks)
    sized = blocks.join(body, "doc_id").join(heading_levels(blocks, body), ["doc_id", "size"], "left")
    n = F.length("text")
    by_size = F.col("size_level").isNotNull() & (n <= MAX_HEADING_CHARS)
    by_weight = (
        F.col("bold") & (n <= MAX_BOLD_CHARS) & ~F.rtrim("text").endswith(".")
        & (F.col("size") >= F.col("body_size"))
    )
    return sized.select(
        *blocks.columns,
        F.when(by_size, F.col("size_level")).when(by_weight, F.lit(3)).otherwise(F.lit(0)).alias("heading"),
    )


def mark_typed_headings(blocks: DataFrame) -> DataFrame:
    """Headings of a typed layout: titles and section headers with text; keeps body labels."""
    label = F.lower(F.coalesce("label", F.lit("")))
    text = strip(F.coalesce("text", F.lit("")))
    header = label.contains("section_header")
    head = (header | (label == "title")) & (text != "")
    level = F.when(header, F.greatest(F.lit(1), F.coalesce("level", F.lit(1)))).otherwise(F.lit(1))
    return (
        blocks.withColumns({"text": text, "page": F.coalesce("page", F.lit(1))})
        .withColumn("heading", F.when(head, level).otherwise(F.lit(0)))
        .filter((F.col("heading") > 0) | (label.isin(*BODY_LABELS) & (F.col("text") != "")))
    )


def sections(marked: DataFrame, max_level: int = LEAN_LEVELS) -> DataFrame:
    """``(doc_id, section_no, level, title, page, section_path, body)`` in reading order.

    A block belongs to the latest heading. The path of a heading holds, for every
    level up to its own, the last heading at or above that level if it is of that
    level. All windows share one exchange and sort by document.
    """
    order = W.partitionBy("doc_id").orderBy("block_no")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    is_head = F.col("heading") > 0
    columns = {"section_no": F.sum(is_head.cast("int")).over(upto).cast("int")}
    for level in range(1, max_level + 1):
        columns[f"_l{level}"] = F.last(
            F.when(is_head & (F.col("heading") <= level), F.struct("heading", "text")), ignorenulls=True
        ).over(upto)
    placed = marked.withColumns(columns)
    path = F.filter(
        F.array(
            *[
                F.when(
                    (F.col(f"_l{lv}.heading") == lv) & (F.lit(lv) <= F.col("heading")), F.col(f"_l{lv}.text")
                )
                for lv in range(1, max_level + 1)
            ]
        ),
        lambda t: t.isNotNull(),
    )
    grouped = placed.groupBy("doc_id", "section_no").agg(
        F.max(F.when(is_head, F.struct("heading", F.col("text").alias("title"), "page", path.alias("path")))).alias("_h"),
        F.min_by("page", "block_no").alias("_page"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(~is_head, F.struct("block_no", "text")))), lambda b: b["text"]
            ),
            "\n\n",
        ).alias("body"),
    )
    done = grouped.select(
        "doc_id",
        "section_no",
        F.coalesce("_h.heading", F.lit(0)).alias("level"),
        F.coalesce("_h.title", F.lit("")).alias("title"),
        F.coalesce("_h.page", "_page").alias("page"),
        F.coalesce("_h.path", F.array().cast("array<string>")).alias("section_path"),
        strip(F.col("body")).alias("body"),
    )
    return done.filter((F.col("title") != "") | (F.col("body") != ""))


def markdown(sects: DataFrame) -> DataFrame:
    """``(doc_id, markdown)``: headings with one to six marks, blocks apart by a blank line."""
    title = F.when(
        F.col("title") != "",
        F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.col("level")))), F.lit(" "), "title"),
    )
    part = F.concat_ws("\n\n", title, F.nullif("body", F.lit("")))
    return sects.groupBy("doc_id").agg(
        F.concat(
            strip(
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct("section_no", part.alias("md")))), lambda p: p["md"]
                    ),
                    "\n\n",
                )
            ),
            F.lit("\n"),
        ).alias("markdown")
    )
