"""Intermediate documents to chunks and metadata, inside one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import FIGURES, FORMULAS, SECTIONS, SIGNALS, TABLES, enforce_chunks, validate_intermediate
from ..functions.text import blank_to_null, digest16, table_text
from .sections import strip

_NESTED = {"sections": SECTIONS, "tables": TABLES, "figures": FIGURES, "formulas": FORMULAS}
_NO_PATH = "array<string>"


def _lists(df: DataFrame) -> DataFrame:
    """Every nested list present and typed, missing ones empty."""
    return df.withColumns(
        {
            name: F.coalesce(F.col(name).cast(kind), F.array().cast(kind))
            if name in df.columns
            else F.array().cast(kind)
            for name, kind in _NESTED.items()
        }
    )


def _piece(text: Column, kind: str, path: Column, page: Column, artifact: Column | None = None) -> Column:
    return F.struct(
        text.alias("text"),
        F.lit(kind).alias("kind"),
        path.alias("section_path"),
        F.coalesce(page.cast("int"), F.lit(1)).alias("page"),
        (artifact if artifact is not None else F.lit(None).cast("string")).alias("artifact_id"),
    )


def chunk_pieces() -> Column:
    """Chunks of one document in order: sections, tables, figures, formulas."""
    no_path = F.array().cast(_NO_PATH)

    def section(s: Column) -> Column:
        title = F.coalesce(s["title"], F.lit(""))
        own = F.when(title != "", F.array(title)).otherwise(no_path)
        path = F.when(F.size(F.coalesce(s["section_path"], no_path)) > 0, s["section_path"]).otherwise(own)
        body = strip(s["body"])
        text = F.when(title != "", strip(F.concat(title, F.lit("\n\n"), body))).otherwise(body)
        return _piece(text, "text", path, s["page"])

    def label(kind: str, item: Column, *choices: Column) -> Column:
        named = F.concat(F.lit(f"{kind} "), item["id"])
        return F.coalesce(*[blank_to_null(c) for c in choices], named)

    written = F.filter("sections", lambda s: F.coalesce(strip(s["body"]), F.lit("")) != "")
    texts = F.transform(written, section)
    whole = strip(F.coalesce("markdown", F.lit("")))
    fallback = F.when(
        (F.size(written) == 0) & (whole != ""), F.array(_piece(whole, "text", no_path, F.lit(1)))
    )
    texts = F.coalesce(fallback, texts)
    tables = F.transform(
        "tables",
        lambda t: _piece(
            label("Table", t, table_text(t["caption"], t["cells"]), t["caption"]), "table", no_path, t["page"], t["id"]
        ),
    )
    figures = F.transform(
        "figures", lambda f: _piece(label("Figure", f, f["caption"]), "figure", no_path, f["page"], f["id"])
    )
    formulas = F.transform(
        "formulas",
        lambda e: _piece(label("Formula", e, e["text"], e["latex"]), "formula", no_path, e["page"], e["id"]),
    )
    return F.concat(texts, tables, figures, formulas)


def document_chunks(intermediate: DataFrame, strict: bool = True) -> DataFrame:
    """The chunk relation of intermediate documents, numbered per document; map-only."""
    validate_intermediate(intermediate)
    pieces = _lists(intermediate).select(
        F.col("document").alias("doc_id"), F.posexplode_outer(chunk_pieces()).alias("pos", "p")
    ).filter(F.col("p").isNotNull())
    chunks = pieces.select(
        F.concat("doc_id", F.lit("-c"), (F.col("pos") + 1).cast("string")).alias("chunk_id"),
        "doc_id",
        "p.text",
        "p.kind",
        "p.section_path",
        F.array().cast(_NO_PATH).alias("parents"),
        "p.page",
        "p.artifact_id",
        F.lit(None).cast("string").alias("group_id"),
        F.lit(None).cast("string").alias("role"),
    )
    return enforce_chunks(chunks) if strict else chunks


def document_meta(intermediate: DataFrame) -> DataFrame:
    """One metadata row per intermediate document; no chunks means human review."""
    validate_intermediate(intermediate)
    have = set(intermediate.columns)

    def opt(name: str, kind: str | object) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    df = _lists(intermediate).withColumn("_n", F.size(chunk_pieces()))
    source = F.coalesce(opt("source_class", "string"), F.lit("pdf-native"))
    none = F.col("_n") == 0
    return df.select(
        F.col("document").alias("id"),
        source.alias("source"),
        opt("source_confidence", "double").alias("source_confidence"),
        F.coalesce(opt("route", "string"), source).alias("route"),
        F.lit(None).cast("string").alias("doi"),
        F.when(none, "needs_human_review").otherwise("ok").alias("status"),
        digest16(F.coalesce("markdown", F.lit(""))).alias("sha256_16"),
        F.col("_n").alias("n_chunks"),
        F.size("tables").alias("n_tables"),
        F.size("figures").alias("n_figures"),
        F.size("formulas").alias("n_formulas"),
        F.lit(None).cast("string").alias("group_id"),
        F.lit(None).cast("string").alias("role"),
        F.when(none, F.array(F.lit("no chunks produced"))).otherwise(F.array().cast(_NO_PATH)).alias("errors"),
        opt("source_signals", SIGNALS).alias("source_signals"),
    )
