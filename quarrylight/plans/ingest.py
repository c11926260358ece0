"""Blocks to intermediate documents, and their product folders."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import FIGURES, FORMULAS, SECTIONS, TABLES, validate_intermediate
from ..operators.artifacts import extract_formulas
from ..operators.chunking import document_chunks, document_meta
from ..operators.sections import markdown, mark_headings, mark_typed_headings, sections
from ..session import ship_package, spill


def _gather(df: DataFrame, name: str, kind, order: str, fields: list[str]) -> DataFrame:
    """One sorted list of structs per document."""
    items = F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("_v"))))
    return df.groupBy("doc_id").agg(F.transform(items, lambda x: x["_v"]).cast(kind).alias(name))


def _serial(id_col: str = "id") -> Column:
    return F.regexp_extract(id_col, r"(\d+)$", 1).cast("int")


def intermediate_documents(
    blocks: DataFrame, tables: DataFrame | None = None, figures: DataFrame | None = None,
    formulas: DataFrame | None = None, classes: DataFrame | None = None,
    typed: bool = False, engine: str = "lean",
) -> DataFrame:
    """One row per document: markdown, sections, artifacts and source class.

    ``typed`` layouts carry their own heading levels; otherwise levels follow from
    font sizes. Lists are gathered per document, as large as the document itself.
    """
    sects = (
        sections(mark_typed_headings(blocks), max_level=9) if typed else sections(mark_headings(blocks))
    )
    out = (
        blocks.select("doc_id").distinct()
        .join(markdown(sects), "doc_id", "left")
        .join(
            _gather(sects, "sections", SECTIONS, "section_no",
                    ["level", "title", "page", "section_path", "body"]),
            "doc_id", "left",
        )
    )
    for found, name, kind in ((tables, "tables", TABLES), (figures, "figures", FIGURES),
                              (formulas, "formulas", FORMULAS)):
        if found is None:
            out = out.withColumn(name, F.array().cast(kind))
        else:
            numbered = found.withColumn("_no", _serial())
            out = out.join(
                _gather(numbered, name, kind, "_no", [f.name for f in kind.elementType.fields]), "doc_id", "left"
            )
    if classes is not None:
        out = out.join(
            classes.select("doc_id", "source_class", "source_confidence",
                           F.col("signals").alias("source_signals"), "route"),
            "doc_id", "left",
        )
    filled = out.withColumns(
        {
            "markdown": F.coalesce("markdown", F.lit("\n")),
            **{
                name: F.coalesce(name, F.array().cast(kind))
                for name, kind in (("sections", SECTIONS), ("tables", TABLES), ("figures", FIGURES),
                                   ("formulas", FORMULAS))
            },
            "engine": F.lit(engine),
        }
    ).withColumnRenamed("doc_id", "document")
    return validate_intermediate(filled)


def ingest_lines(lines: DataFrame) -> DataFrame:
    """Formulas of page lines ``(doc_id, page, line_no, text)``."""
    return extract_formulas(lines)


def write_product(intermediate: DataFrame, outputs: str) -> DataFrame:
    """Write one product folder per document and return ``(doc_id, path, n_chunks, status)``.

    Each task writes the folders of its own documents through the file system of
    ``outputs`` (local path or URI). Files are replaced as a whole, so a repeated
    task leaves the same files.
    """
    chunks = document_chunks(intermediate)
    lines = chunks.groupBy("doc_id").agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int").alias("n"),
                        F.to_json(
                            F.struct("chunk_id", "doc_id", "text", "kind", "section_path", "parents", "page",
                                     "artifact_id")
                        ).alias("line"),
                    )
                )
            ),
            lambda x: x["line"],
        ).alias("lines")
    )
    meta = document_meta(intermediate).select(
        F.col("id").alias("doc_id"), "status", "n_chunks",
        F.to_json(F.struct(*document_meta(intermediate).columns), {"ignoreNullFields": "false"}).alias("meta"),
    )
    docs = intermediate.select(
        F.col("document").alias("doc_id"), "markdown",
        *[F.to_json(F.col(n)).alias(n) for n in ("tables", "figures", "formulas")],
    )
    files = docs.join(meta, "doc_id").join(lines, "doc_id", "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        if "://" in outputs:
            system, root = fs.FileSystem.from_uri(outputs)
        else:
            system, root = fs.LocalFileSystem(), outputs

        def put(path: str, text: str) -> None:
            with system.open_output_stream(path) as out:
                out.write(text.encode("utf-8"))

        def pretty(obj) -> str:
            return json.dumps(obj, ensure_ascii=False, indent=2)

        for batch in batches:
            for row in batch.itertuples():
                base = f"{root}/{row.doc_id}"
                for sub in ("tables", "figures", "formulas"):
                    system.create_dir(f"{base}/{sub}", recursive=True)
                put(f"{base}/document.md", row.markdown)
                found = row.lines if row.lines is not None else []
                put(f"{base}/chunks.jsonl", "".join(line + "\n" for line in found))
                for sub, end in (("tables", ".table.json"), ("figures", ".json"), ("formulas", ".json")):
                    for item in json.loads(getattr(row, sub) or "[]"):
                        put(f"{base}/{sub}/{item['id']}{end}", pretty({**item, "doc_id": row.doc_id}))
                meta = json.loads(row.meta)
                if meta.get("source_signals") is None:
                    meta.pop("source_signals", None)
                put(f"{base}/document.meta.json", pretty(meta))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "path": [f"{outputs}/{d}" for d in batch["doc_id"]],
                    "n_chunks": batch["n_chunks"],
                    "status": batch["status"],
                }
            )

    ship_package(files.sparkSession)
    written = files.mapInPandas(write, "doc_id string, path string, n_chunks int, status string")
    return spill(written, "written")
