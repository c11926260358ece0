"""Index build: chunk table to postings, term statistics, keywords and vectors.

The index is a folder of Parquet tables that is rebuilt as a whole:

==============  =====================================================================
``chunks``      the chunk relation, text made indexable
``terms``       one row per chunk: its counted search words, length, top keywords
``shards``      postings of neighbouring chunks by term, in blocks with their largest
                impacts
``term_stats``  ``(term, df)``
``vectors``     ``(chunk_id, vector)``
``stats``       one row of corpus totals
==============  =====================================================================
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.counts import counted_chunks
from ..operators.blocks import posting_shards
from ..operators.embed import DEFAULT_MODEL, embed
from ..session import spread

KEYWORDS_KEPT = 12


@dataclass(frozen=True)
class CorpusIndex:
    """A built index. Tables are lazy scans; totals are read once.

    With ``source`` (chunks) tables are written when they are first asked for.
    """

    spark: SparkSession
    path: str
    model: str = DEFAULT_MODEL
    source: DataFrame | None = None
    built: set[str] = field(default_factory=set, compare=False)

    def table(self, name: str) -> DataFrame:
        if self.source is not None and name not in self.built:
            _STEPS[name](self)
            self.built.add(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def stats(self) -> Row:
        return self.table("stats").first()

    @property
    def average_length(self) -> float:
        """Words per chunk; 1 where there are none."""
        return self.stats["n_tokens"] / self.stats["n_chunks"] if self.stats and self.stats["n_tokens"] else 1.0

    @property
    def postings(self) -> DataFrame:
        """Rows ``(term, chunk_id, tf, dl)``; map-only."""
        rows = self.table("terms").select("chunk_id", "dl", F.explode("terms").alias("t"))
        return rows.select("t.term", "chunk_id", F.col("t.n").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def keywords(self) -> DataFrame:
        """Rows ``(chunk_id, doc_id, section_path, term, kw_rank)``, rank from 1.

        Only text chunks with text carry keywords of the term index.
        """
        return (
            self.table("terms")
            .filter((F.col("kind") == "text") & F.col("has_text"))
            .select(
                "chunk_id", "doc_id", "section_path",
                F.posexplode_outer("keywords").alias("pos", "term"),
            )
            .filter(F.col("term").isNotNull())
            .select("chunk_id", "doc_id", "section_path", "term",
                    (F.col("pos") + 1).alias("kw_rank"))
        )


def _write(index: CorpusIndex, name: str, rows: DataFrame, **options: str) -> None:
    rows.write.mode("overwrite").options(**options).parquet(f"{index.path}/{name}")


def _chunks(index: CorpusIndex) -> None:
    _write(index, "chunks", index.source)


def _terms(index: CorpusIndex) -> None:
    _write(index, "terms", counted_chunks(index.chunks, KEYWORDS_KEPT))


def _stats(index: CorpusIndex) -> None:
    totals = index.table("terms").agg(
        F.count("*").alias("n_chunks"),
        F.count_distinct("doc_id").alias("n_docs"),
        F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"),
    )
    _write(index, "stats", totals.coalesce(1))


def _shards(index: CorpusIndex) -> None:
    # One row group per file, so that a shard is never read by two tasks.
    shards = posting_shards(spread(index.table("terms")), index.average_length)
    _write(index, "shards", shards, **{"parquet.block.size": str((1 << 31) - 1)})


def _term_stats(index: CorpusIndex) -> None:
    if "shards" in index.built:
        rows = index.table("shards").filter(F.col("term").isNotNull()).select("term", "df")
    else:
        rows = index.table("terms").select(F.explode("terms.term").alias("term"), F.lit(1).alias("df"))
    _write(index, "term_stats", rows.groupBy("term").agg(F.sum("df").alias("df")))


def _vectors(index: CorpusIndex) -> None:
    found = embed(index.chunks.select("chunk_id", "text"), "text", index.model)
    _write(index, "vectors", found.select("chunk_id", "vector"))


_STEPS = {
    "chunks": _chunks, "terms": _terms, "stats": _stats, "shards": _shards, "term_stats": _term_stats, "vectors": _vectors,
}


def lazy_index(chunks: DataFrame, path: str, model: str = DEFAULT_MODEL) -> CorpusIndex:
    """An index whose tables are written under ``path`` when they are first asked for."""
    return CorpusIndex(chunks.sparkSession, path, model, chunks)


def build_index(chunks: DataFrame, path: str, model: str = DEFAULT_MODEL) -> CorpusIndex:
    """Write the index tables under ``path`` and return the opened index.

    Postings stay with their chunks, in shards; only term statistics are shuffled,
    as rows counted before.
    """
    index = lazy_index(chunks, path, model)
    for name in _STEPS:
        index.table(name)
    return open_index(index.spark, path, model)


def open_index(spark: SparkSession, path: str, model: str = DEFAULT_MODEL) -> CorpusIndex:
    return CorpusIndex(spark, path, model)
