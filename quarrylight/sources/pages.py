"""Text blocks from HTML pages, and the seam for other document parsers.

Everything after this module works on the ``blocks`` relation
``(doc_id, page, block_no, label, level, size, bold, text)``.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import ContractError

# Font size that stands for each block tag.
TAG_SIZES = {"h1": 20.0, "h2": 17.0, "h3": 14.0, "h4": 12.5, "h5": 12.0, "h6": 11.5}
TEXT_SIZE = 10.0
# Elements without readable text.
SKIPPED = r"(?si)<!--.*?-->|<(script|style|head|template|noscript)\b.*?</\1\s*>"
BLOCK_OPEN = r"(?i)<(h[1-6]|p|li|figcaption)(\s[^>]*)?>"
# Tags between which other text is a block of its own.
BLOCK_BREAK = (
    r"(?i)</(h[1-6]|p|li|figcaption)\s*>"
    r"|</?(address|article|aside|blockquote|body|div|dl|dt|dd|figure|footer|form|header|html|main|nav|ol|pre|section|table|td|th|tr|ul)(\s[^>]*)?>"
)
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain_text(markup: Column) -> Column:
    """Markup without tags, entities decoded, white space collapsed."""
    text = F.regexp_replace(markup, "<[^>]*>", " ")
    for code, char in ENTITIES.items():
        text = F.replace(text, F.lit(code), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def html_blocks(pages: DataFrame, doc_id: Column, html: str = "html") -> DataFrame:
    """One row per non-empty heading, paragraph or other run of text, in reading order; map-only.

    All readable text of a page is in exactly one block, also before the first block tag and
    between blocks.
    """
    body = F.regexp_replace(F.translate(F.col(html), "\u0001\u0002", "  "), SKIPPED, " ")
    broken = F.regexp_replace(body, BLOCK_BREAK, "\u0001\u0002")
    marked = F.regexp_replace(broken, BLOCK_OPEN, "\u0001$1\u0002")
    pieces = F.split(F.concat(F.lit("\u0002"), marked), "\u0001")
    rows = pages.select(doc_id.alias("doc_id"), F.posexplode_outer(pieces).alias("pos", "piece")).filter(
        F.col("piece").isNotNull()
    )
    tag = F.lower(F.substring_index("piece", "\u0002", 1))
    content = F.substring(F.col("piece"), F.length(tag) + 2, F.length("piece"))
    size = F.lit(TEXT_SIZE)
    for name, points in TAG_SIZES.items():
        size = F.when(tag == name, F.lit(points)).otherwise(size)
    return rows.select(
        "doc_id",
        F.lit(1).alias("page"),
        (F.col("pos") + 1).alias("block_no"),
        F.when(tag.startswith("h"), "section_header").when(tag == "li", "list_item")
        .when(tag == "figcaption", "caption").otherwise("text").alias("label"),
        F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int")).alias("level"),
        size.alias("size"),
        F.ltrim(content).startswith("<b>").alias("bold"),
        plain_text(content).alias("text"),
    ).filter(F.col("text") != "")


_PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_parser(engine: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    """Plug in a parser from ``binaryFile`` rows to the ``blocks`` relation."""
    _PARSERS[engine] = parse


def choose_engine(engine: str = "auto", env: str = "QUARRYLIGHT_ENGINE") -> str:
    """Named engine, else the environment, else the structural parser when installed."""
    name = (engine or "auto").lower()
    if name != "auto":
        return name
    named = os.environ.get(env, "").strip().lower()
    if named:
        return named
    return "docling" if importlib.util.find_spec("docling") is not None else "lean"


def parse_files(spark: SparkSession, path: str, engine: str = "auto") -> DataFrame:
    """Blocks of every file at ``path`` by the chosen engine."""
    name = choose_engine(engine)
    if name not in _PARSERS:
        raise ContractError(f"no parser registered for engine {name!r}")
    return _PARSERS[name](spark.read.format("binaryFile").load(path))
