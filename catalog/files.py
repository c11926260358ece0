"""Scans of chunk files that the query itself writes from the documents, odd fields and bad lines included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import scratch_path
from quarrylight.sources import products as P

from .workspace import read

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str):
    def add(fn):
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return add


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """A JSON line per document: pages as number, text, decimal or junk; paths as list or text."""
    n = F.col("doc_id")
    body = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    page = (
        F.when(n % 5 == 0, F.concat(F.lit('"page":'), n % 40))
        .when(n % 5 == 1, F.concat(F.lit('"page":"'), n % 40, F.lit('"')))
        .when(n % 5 == 2, F.lit('"page":"ii"')).when(n % 5 == 3, F.concat(F.lit('"page":'), n % 40, F.lit(".0")))
        .otherwise('"page":null')
    )
    path = (
        F.when(n % 3 == 0, F.concat(F.lit('"section_path":["'), "lang", F.lit('","'), "source", F.lit('"]')))
        .when(n % 3 == 1, F.lit('"section_path":"Intro"')).otherwise('"section_path":null')
    )
    kind = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, '"kind":"figure"').otherwise('"kind":"text"')
    line = F.concat(
        F.lit('{"chunk_id":"c'), n, F.lit('","doc_id":"'), "source", F.lit('","artifact_id":"a'), n, F.lit('",'), page,
        F.lit(","), path, F.lit(","), kind, F.lit(","), F.substring(body, 2, 2_000_000_000),
    )
    return read(spark, folder, "documents").select(n, line.alias("value"))


def _stored(spark: SparkSession, folder: str, bad_lines: bool) -> str:
    """Folders a and b; b repeats every fourth line with another page, and holds text that is no JSON object."""
    root = scratch_path(spark, "chunk-files")
    lines = _lines(spark, folder)
    lines.select("value").write.text(f"{root}/a/chunks.jsonl")
    again = lines.where("doc_id % 4 = 0").select(F.regexp_replace("value", '"page":[^,]*,', '"page":77,').alias("value"))
    if bad_lines:
        broken = lines.where("doc_id % 11 = 0").select(F.element_at(F.array(F.lit("{broken"), F.lit("[1]"), F.lit("7")), F.pmod("doc_id", F.lit(3)).cast("int") + 1))
        again = again.union(broken)
    again.write.text(f"{root}/b/chunks.jsonl")
    return root


def _shown(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id", "doc_id", F.md5("text").alias("text_md5"), "kind", F.array_join("section_path", "/").alias("path"), "page", "artifact_id"
    )


_ROWS = """
first AS (
  SELECT doc_id AS n, 'c' || doc_id AS chunk_id, source AS doc_id, coalesce(text, '') AS text,
         CASE WHEN coalesce(length(text), 0) = 0 THEN 'figure' ELSE 'text' END AS kind,
         CASE WHEN doc_id % 3 = 0 THEN lang || '/' || source END AS path,
         CASE WHEN doc_id % 5 IN (0, 1, 3) THEN (doc_id % 40)::INT END AS page, 'a' || doc_id AS artifact_id FROM documents),
again AS (SELECT * REPLACE (77 AS page) FROM first WHERE n % 4 = 0)"""
_COLUMNS = "chunk_id, doc_id, md5({text}) AS text_md5, kind, path, page, artifact_id"
_SHOWN = _COLUMNS.format(text="text")


@query("scan_tolerant", f"WITH {_ROWS} SELECT {_SHOWN} FROM first UNION ALL SELECT {_SHOWN} FROM again")
def scan_tolerant(spark, folder):
    return _shown(P.scan_chunks(spark, _stored(spark, folder, True)))


_NAMED = _COLUMNS.format(text="CASE WHEN text = '' THEN kind || ' ' || artifact_id ELSE text END")


@query("scan_strict", f"WITH {_ROWS} SELECT {_NAMED} FROM first UNION ALL SELECT {_NAMED} FROM again")
def scan_strict(spark, folder):
    return _shown(P.scan_chunks_strict(spark, _stored(spark, folder, False)))


@query("latest_chunks", f"WITH {_ROWS} SELECT {_SHOWN} FROM first WHERE n % 4 <> 0 UNION ALL SELECT {_SHOWN} FROM again")
def latest_chunks(spark, folder):
    return _shown(P.latest_chunks(spark, _stored(spark, folder, True)))
