"""Concept phrases of chunks, their co-occurrence graph and its pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed

# A token is a word or one breaking character; plural endings.
PHRASE_TOKEN = r"[A-Za-z][A-Za-z\-]*|[^A-Za-z\s]"
PHRASE_BREAK = r" *\|[| ]*"
PLURAL = r"^(.{2,}[^sui])s$"


def phrases(
    text: Column, drop_generic: bool = True, min_chars: int = 3, max_tokens: int = 4
) -> Column:
    """Distinct concepts of a text.

    A candidate is an unbroken run of content words: function words, punctuation,
    digits and other characters end it. Words lose a plural ending. Long runs,
    short strings and single general words are rejected.
    """
    stop = list(fixed.KEYWORD_STOP)
    general = sorted(set(fixed.KEYWORD_STOP) | set(fixed.GENERIC_CONCEPTS))
    tokens = F.regexp_extract_all(text, F.lit(PHRASE_TOKEN), F.lit(0))
    marked = F.transform(
        F.transform(tokens, F.lower),
        lambda t: F.when(t.isin(stop) | ~t.rlike("^[a-z]"), F.lit("|")).otherwise(t),
    )
    runs = F.filter(F.split(F.array_join(marked, " "), PHRASE_BREAK), lambda r: r != "")
    words = F.transform(
        runs, lambda r: F.transform(F.split(F.trim(r), " "), lambda w: F.regexp_replace(w, PLURAL, "$1"))
    )
    kept = F.filter(
        words,
        lambda p: (F.size(p) <= max_tokens)
        & (F.length(F.array_join(p, " ")) >= min_chars)
        & (
            ~((F.size(p) == 1) & F.element_at(p, 1).isin(general)) if drop_generic else F.lit(True)
        ),
    )
    return F.array_distinct(F.transform(kept, lambda p: F.array_join(p, " ")))


def concept_chunks(
    chunks: DataFrame, drop_generic: bool = True, min_chars: int = 3, max_tokens: int = 4
) -> DataFrame:
    """``(concept, chunk_id, doc_id)`` once per chunk; map-only."""
    text = chunks.filter((F.col("kind") == "text") & (F.length(F.trim("text")) > 0))
    return text.select(
        "chunk_id", "doc_id",
        F.explode_outer(phrases(F.col("text"), drop_generic, min_chars, max_tokens)).alias("concept"),
    ).filter(F.col("concept").isNotNull())


def concept_stats(incidence: DataFrame) -> DataFrame:
    """``(concept, freq, doc_count)``: chunks and documents per concept."""
    return incidence.groupBy("concept").agg(
        F.count("*").alias("freq"), F.count_distinct("doc_id").alias("doc_count")
    )


def surviving(stats: DataFrame, min_freq: int, max_concepts: int | None) -> DataFrame:
    """Frequent concepts; beyond ``max_concepts`` the most frequent, ties by name."""
    kept = stats.filter(F.col("freq") >= min_freq)
    if max_concepts is None:
        return kept
    return kept.orderBy(F.desc("freq"), "concept").limit(max_concepts)


def cooccurrence(incidence: DataFrame, per_chunk: int = 40) -> DataFrame:
    """``(a, b, weight, doc_w)`` with ``a < b`` from ``(concept, freq, chunk_id, doc_id)``.

    Each chunk keeps its ``per_chunk`` rarest concepts. Rows meet by document, in one exchange: ranking, pairing and
    counting a document's pairs stay in its task. Only pairs with their two counts, added up per task, are shuffled
    again, without documents.
    """
    order = W.partitionBy("doc_id", "chunk_id").orderBy("freq", "concept")
    kept = incidence.select("concept", "freq", "chunk_id", "doc_id").repartition("doc_id").withColumn(
        "_rn", F.row_number().over(order)
    ).filter(F.col("_rn") <= per_chunk)
    grouped = kept.groupBy("doc_id", "chunk_id").agg(F.sort_array(F.collect_list("concept")).alias("_c"))
    pairs = grouped.select(
        "doc_id",
        F.explode_outer(
            F.flatten(
                F.transform(
                    "_c",
                    lambda a, i: F.transform(
                        F.slice(F.col("_c"), i + 2, F.lit(per_chunk)),
                        lambda b: F.struct(a.alias("a"), b.alias("b")),
                    ),
                )
            )
        ).alias("p"),
    ).filter(F.col("p").isNotNull())
    by_doc = pairs.groupBy("doc_id", "p.a", "p.b").agg(F.count("*").alias("n"))
    return by_doc.groupBy("a", "b").agg(F.sum("n").alias("weight"), F.count("doc_id").alias("doc_w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Directed copy ``(u, v, weight)`` of undirected edges."""
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight")
    )


def prune_edges(edges: DataFrame, min_weight: int = 2, max_degree: int | None = None) -> DataFrame:
    """Drop weak edges, then optionally every edge of a node above ``max_degree``.

    Nodes are the ends of the remaining edges, so isolated nodes drop out. Hubs are
    chosen once, on the degrees before their removal.
    """
    strong = edges.filter(F.col("weight") >= min_weight)
    if max_degree is None:
        return strong
    hubs = (
        both_ways(strong).groupBy("u").agg(F.count("*").alias("degree"))
        .filter(F.col("degree") > max_degree).select("u")
    )
    return strong.join(hubs.withColumnRenamed("u", "a"), "a", "left_anti").join(
        hubs.withColumnRenamed("u", "b"), "b", "left_anti"
    ).select("a", "b", "weight", "doc_w")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("concept")).unionByName(
        edges.select(F.col("b").alias("concept"))
    ).distinct()


def max_incident(edges: DataFrame) -> DataFrame:
    """``(u, max_weight)``: the heaviest edge of each node."""
    return both_ways(edges).groupBy("u").agg(F.max("weight").alias("max_weight"))
