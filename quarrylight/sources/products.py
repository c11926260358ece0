"""Scans of the per-document product folders (``<outputs>/<slug>/...``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import CHUNK, CHUNK_LABELS, CHUNK_LINE, DOCUMENT_META, ContractError, enforce_chunks
from ..functions import fixed
from ..functions.text import blank_to_null


def path_exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return found is not None and len(found) > 0


def _slug_of(path: Column) -> Column:
    return F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def _field(text: Column, kind: T.DataType) -> Column:
    """A JSON field, given as text, in its declared type; null where it has no such value."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.IntegerType):
        return text.try_cast("double").try_cast("int")
    if isinstance(kind, (T.DoubleType, T.BooleanType)):
        return text.try_cast(kind)
    opening = "[" if isinstance(kind, T.ArrayType) else "{"
    return F.when(F.ltrim(text).startswith(opening), F.from_json(text, kind))


def parsed_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """``lines`` with ``schema``'s fields read from JSON text, and ``_malformed``.

    Every field is taken as text and cast by itself: a field of another type becomes null and the
    row stays. Only text that is no JSON object is malformed; blank text is left out.
    """
    loose = T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema), T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rest = [c for c in lines.columns if c not in schema.fieldNames()]
    read = lines.filter(F.trim(F.regexp_replace(column, r"\s+", " ")) != "").select(
        *rest, F.from_json(F.col(column), loose, options).alias("_json")
    )
    whole = F.ltrim(F.regexp_replace(column, r"^\s+", "")).startswith("{") & F.col("_json._bad").isNull()
    return read.select(
        *rest, *[_field(F.col(f"_json.{f.name}"), f.dataType).alias(f.name) for f in schema],
        (~F.coalesce(whole, F.lit(False))).alias("_malformed"),
    )


def _chunk_lines(spark: SparkSession, outputs: str) -> DataFrame:
    """Lines of all chunk files with their place: ``value``, ``_place`` (file, block, position)."""
    pattern = f"{outputs}/*/chunks.jsonl"
    if not path_exists(spark, pattern):
        return spark.createDataFrame([], "value string, _place struct<file:string,block:bigint,position:bigint>")
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )
    return spark.read.text(pattern).select("value", place.alias("_place"))


def scan_chunks(spark: SparkSession, outputs: str) -> DataFrame:
    """Tolerant scan: text that is no JSON object is dropped, no contract is applied."""
    raw = parsed_lines(_chunk_lines(spark, outputs), CHUNK_LINE)
    return raw.filter(~F.col("_malformed")).select(*CHUNK.fieldNames(), *CHUNK_LABELS)


def indexable_text() -> Column:
    """Text of a chunk, or the first label it has, so that no row is empty."""
    named = F.concat_ws(
        " ",
        F.coalesce(F.col("kind"), F.lit("artifact")),
        F.coalesce(blank_to_null(F.col("artifact_id")), F.col("chunk_id"), F.lit("")),
    )
    return F.coalesce(
        *[blank_to_null(F.col(c)) for c in ("text", *CHUNK_LABELS)], F.trim(named)
    )


def scan_chunks_strict(spark: SparkSession, outputs: str) -> DataFrame:
    """Strict scan for indexing: bad JSON and contract violations raise.

    The first malformed line is located with file and line number before any index work
    starts. Fields of another type become null, as in the tolerant scan.
    """
    pattern = f"{outputs}/*/chunks.jsonl"
    if not path_exists(spark, pattern):
        raise ValueError(f"no chunks found under {outputs}; nothing to index")
    raw = parsed_lines(_chunk_lines(spark, outputs), CHUNK_LINE)
    bad = raw.filter("_malformed").select("_place.file", "value").take(1)
    if bad:
        where, line = bad[0]
        raise ValueError(f"{where}:{_line_number(spark, where, line)}: invalid JSON")
    checked = enforce_chunks(raw.drop("value", "_place", "_malformed"))
    return checked.select(
        *[
            indexable_text().alias("text") if name == "text" else F.col(name)
            for name in CHUNK.fieldNames()
        ]
    )


def _line_number(spark: SparkSession, path: str, line: str) -> int:
    """Line number of ``line``; runs only on the error path, over that one file."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    hit = parts.filter(F.col("line") == line).agg(F.min("pos").alias("pos")).first()
    return (hit["pos"] if hit and hit["pos"] is not None else -1) + 1


def require_rows(chunks: DataFrame, where: str) -> DataFrame:
    if not chunks.take(1):
        raise ValueError(f"no chunks found under {where}; nothing to index")
    return chunks


def latest_chunks(spark: SparkSession, outputs: str) -> DataFrame:
    """One row per chunk id; the last one in (slug, position) order wins.

    A maximum per id is combined before its shuffle, so an id with very many lines is not
    gathered in one task.
    """
    raw = parsed_lines(_chunk_lines(spark, outputs), CHUNK_LINE).filter("NOT _malformed AND chunk_id IS NOT NULL")
    row = F.struct(*CHUNK.fieldNames())
    return raw.groupBy("chunk_id").agg(F.max_by(row, "_place").alias("_last")).select("_last.*")


# Name, folder and file ending of each artifact kind.
ARTIFACT_FOLDERS = {
    "t": ("table", "tables", ".table.json"),
    "f": ("figure", "figures", ".json"),
    "e": ("formula", "formulas", ".json"),
}


def artifact_files(spark: SparkSession, outputs: str, kind: str, docs: str = "*") -> DataFrame:
    """``(doc_id, file_id, body)`` of the artifact files of a kind, one row per file; ``docs`` is a glob of folders."""
    _, folder, ending = ARTIFACT_FOLDERS[kind]
    pattern = f"{outputs}/{docs}/{folder}/*{ending}"
    if not path_exists(spark, pattern):
        return spark.createDataFrame([], "doc_id string, file_id string, body string")
    path = F.url_decode(F.col("_metadata.file_path"))
    return spark.read.text(pattern, wholetext=True).select(
        F.element_at(F.split(path, "/"), -3).alias("doc_id"),
        F.regexp_replace(F.element_at(F.split(path, "/"), -1), ending.replace(".", r"\.") + "$", "").alias("file_id"),
        F.col("value").alias("body"),
    )


def scan_meta(spark: SparkSession, outputs: str) -> DataFrame:
    """Document metadata; unreadable files are skipped. Adds the folder name."""
    pattern = f"{outputs}/*/document.meta.json"
    if not path_exists(spark, pattern):
        return spark.createDataFrame([], DOCUMENT_META).withColumn("slug", F.lit(""))
    files = spark.read.text(pattern, wholetext=True).select("value", _slug_of(F.col("_metadata.file_path")).alias("slug"))
    return parsed_lines(files, DOCUMENT_META).filter("NOT _malformed").select(*DOCUMENT_META.fieldNames(), "slug")


def list_documents(meta: DataFrame) -> DataFrame:
    """Corpus overview: seven columns per document, ordered by folder name."""
    return meta.orderBy("slug").select(
        "id", "source", "source_confidence", "n_chunks", "n_tables", "n_figures", "n_formulas"
    )


def document_sources(meta: DataFrame) -> DataFrame:
    """Document id to native, scan or unknown; both scan classes are scan."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return meta.select(
        F.coalesce(blank_to_null(F.col("id")), F.col("slug")).alias("doc_id"),
        F.when(source == "pdf-native", F.lit("native"))
        .when(source.startswith("pdf-scan"), F.lit("scan"))
        .otherwise(F.lit("unknown"))
        .alias("doc_class"),
    )


def document_features(meta: DataFrame) -> DataFrame:
    """Traits used as effect modifiers. Here every class but native counts as scan."""
    key = F.coalesce(F.col("id"), F.col("slug"))
    positive = lambda name: F.coalesce(F.col(name), F.lit(0)) > 0
    return meta.select(
        key.alias("doc_id"),
        F.when(F.col("source") == "pdf-native", F.lit("native")).otherwise(F.lit("scan")).alias("source"),
        F.regexp_extract(key, fixed.YEAR_PATTERN, 1).try_cast("int").alias("year"),
        F.coalesce(F.col("n_chunks"), F.lit(0)).alias("n_chunks"),
        positive("n_tables").alias("has_tables"),
        positive("n_formulas").alias("has_formulas"),
    )


def scan_gold(spark: SparkSession, path: str) -> DataFrame:
    """External gold: a JSON array or an object with ``items``. Fields of another type are null."""
    item = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("scope", T.StringType()),
            T.StructField("question", T.StringType()),
            T.StructField("gold_chunk_ids", T.ArrayType(T.StringType())),
            T.StructField("answerable", T.BooleanType()),
        ]
    )
    wrapped = T.StructType([T.StructField("items", T.ArrayType(T.StringType()))])
    text = F.ltrim(F.regexp_replace("value", r"^\s+", ""))
    several = F.coalesce(F.from_json("value", wrapped)["items"], F.array(F.col("value")))
    entries = F.when(text.startswith("["), F.from_json("value", T.ArrayType(T.StringType()))).otherwise(several)
    files = spark.read.text(path, wholetext=True)
    return parsed_lines(files.select(F.explode(entries).alias("value")), item).filter("NOT _malformed").select(*item.fieldNames())


def doi_list(spark: SparkSession, path: str) -> DataFrame:
    """One DOI per line; text after ``#`` is a comment."""
    from ..functions.text import normalize_doi

    bare = F.trim(F.regexp_replace(F.col("value"), r"#.*$", ""))
    return (
        spark.read.text(path)
        .select(normalize_doi(bare).alias("doi"))
        .filter(F.col("doi").isNotNull())
    )


__all__ = [
    "ContractError", "doi_list", "document_features", "document_sources", "indexable_text",
    "latest_chunks", "list_documents", "parsed_lines", "path_exists", "require_rows", "scan_chunks",
    "scan_chunks_strict", "scan_gold", "scan_meta",
]
