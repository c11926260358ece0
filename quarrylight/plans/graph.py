"""Concept graph: build and batch search."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.centroids import centroids
from ..operators.communities import detect_communities
from ..operators.concepts import (
    concept_chunks, concept_stats, cooccurrence, nodes_of, prune_edges, surviving,
)
from ..operators.embed import embed
from ..operators.expansion import (
    accumulate, expand, fuse, rank_communities, rank_incidence, select_seeds,
)
from ..recipe import GraphSettings, SearchSettings
from ..session import broadcast_within, cut_lineage, spill
from ..sources.products import path_exists
from .index import CorpusIndex
from .search import QueryBatch, hits, hybrid_search

CODE_VERSION = "graph-1.0"


@dataclass(frozen=True)
class ConceptGraph:
    """A built graph: tables ``concepts``, ``concept_chunks``, ``edges``, ``communities``, ``meta``."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def meta(self) -> Row:
        return self.table("meta").first()


def open_graph(spark: SparkSession, path: str) -> ConceptGraph | None:
    """The graph at ``path``, or None when none was built."""
    return ConceptGraph(spark, path) if path_exists(spark, f"{path}/meta/_SUCCESS") else None


def build_graph(chunks: DataFrame, path: str, settings: GraphSettings | None = None) -> ConceptGraph:
    """Extract concepts, prune, connect, group, embed and write.

    The surviving concepts are at most ``max_concepts`` rows, which bounds the
    broadcast that filters the incidence rows before any pair is formed.
    """
    g = settings or GraphSettings()
    spark = chunks.sparkSession
    graph = ConceptGraph(spark, path)
    incidence = spill(
        concept_chunks(chunks, g.drop_generic, g.min_concept_chars, g.max_concept_tokens), "incidence"
    )
    stats = spill(concept_stats(incidence), "concept_stats")
    kept = cut_lineage(surviving(stats, g.min_concept_freq, g.max_concepts))
    carried = incidence.join(broadcast_within(kept, g.max_concepts), "concept")
    edges = prune_edges(
        cooccurrence(carried, g.max_concepts_per_chunk), g.min_edge_weight, g.max_node_degree
    )
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    edges = graph.table("edges")

    labels = detect_communities(edges, g.resolution, g.seed)
    # At most max_concepts communities, numbered by size, then by smallest member.
    numbers = (
        labels.groupBy("community").agg(F.count("*").alias("size"))
        .withColumn("number", F.row_number().over(W.orderBy(F.desc("size"), "community")) - 1)
    )
    named = labels.join(broadcast_within(numbers, g.max_concepts), "community").select(
        "concept", F.col("number").alias("community")
    )
    nodes = nodes_of(edges).join(kept, "concept").join(named, "concept")
    embed(nodes, "concept", g.embedder_model, unit=True).write.mode("overwrite").parquet(f"{path}/concepts")
    concepts = graph.table("concepts")
    rank_incidence(
        incidence.join(broadcast_within(concepts.select("concept"), g.max_concepts), "concept", "left_semi")
    ).write.mode("overwrite").parquet(f"{path}/concept_chunks")
    centroids(concepts, "community", "vector").write.mode("overwrite").parquet(f"{path}/communities")

    n_chunks = counted_chunks(chunks)
    sizes = concepts.groupBy("community").count().agg(
        F.count("*").alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("largest")
    ).first()
    meta = {
        "embedder_model": g.embedder_model,
        "n_chunks": n_chunks,
        "n_concepts_raw": stats.count(),
        "n_concepts_kept": concepts.count(),
        "n_edges": edges.count(),
        "n_communities": sizes["n"],
        "largest_community": sizes["largest"],
        "code_version": CODE_VERSION,
        "params": json.dumps(
            {k: v for k, v in vars(g).items() if k not in ("path", "enabled")}, sort_keys=True, default=list
        ),
    }
    spark.createDataFrame(
        [tuple(meta.values())],
        "embedder_model string, n_chunks long, n_concepts_raw long, n_concepts_kept long, n_edges long, "
        "n_communities long, largest_community long, code_version string, params string",
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return graph


def counted_chunks(chunks: DataFrame) -> int:
    """Text chunks that are not blank: the number a graph is built on and compared with later."""
    return chunks.filter((F.col("kind") == "text") & (F.length(F.trim("text")) > 0)).count()


@dataclass(frozen=True)
class GraphResult:
    ranked: DataFrame
    facts: DataFrame


def graph_search(
    graph: ConceptGraph | None, batch: QueryBatch, settings: GraphSettings | None = None,
    top_k: int | None = None, index: CorpusIndex | None = None,
    search: SearchSettings | None = None, chunks: DataFrame | None = None,
) -> GraphResult:
    """Ranked chunks per query and, per query, the counts of what was searched.

    Without a graph or without concepts the result is empty, or the hybrid result
    when ``fallback_hybrid`` is set. Chunks missing from ``chunks`` are skipped
    before the cut to ``top_k``.
    """
    g = settings or GraphSettings()
    search = search or SearchSettings()
    k = top_k or search.top_k
    if graph is None or graph.meta["n_concepts_kept"] == 0:
        return _fallback(batch, g, k, index, search)
    if graph.meta["embedder_model"] != g.embedder_model:
        warnings.warn("the graph was embedded with another model; similarities may be meaningless")
    concepts, incidence = graph.table("concepts"), graph.table("concept_chunks")
    queries = cut_lineage(
        embed(batch.frame, "question", g.embedder_model, unit=True).select("query_id", "vector")
    )
    seeds = cut_lineage(
        select_seeds(concepts, queries, g.seed_sim_min, g.seed_z, g.seed_top_n, g.seed_concepts)
    )
    membership = concepts.select("concept", "community")
    relevant = cut_lineage(
        rank_communities(
            seeds, membership, graph.table("communities"), queries, g.relevant_communities,
            g.community_prior_w, g.seed_top_n + len(g.seed_concepts),
        ).filter("relevant")
    )
    active = expand(seeds, graph.table("edges"), membership, relevant, incidence, g)
    found = accumulate(active, incidence, g.multi_hit_w)
    if chunks is not None:
        current = counted_chunks(chunks)
        if current != graph.meta["n_chunks"]:
            warnings.warn(
                f"stale graph: built on {graph.meta['n_chunks']} chunks, the corpus has {current}"
            )
    ranked = fuse(found, seeds, incidence, k, g.fusion, g.rrf_k, g.alpha, chunks)
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    facts = (
        count(seeds, "n_seeds")
        .join(count(active, "n_active_concepts"), "query_id")
        .join(count(relevant, "n_communities_searched"), "query_id")
        .join(count(found, "n_candidates"), "query_id")
    )
    return GraphResult(ranked, facts)


FACTS = ("n_seeds", "n_active_concepts", "n_communities_searched", "n_candidates")


def graph_hits(
    graph: ConceptGraph | None, batch: QueryBatch, index: CorpusIndex, settings: GraphSettings | None = None,
    top_k: int | None = None, search: SearchSettings | None = None,
) -> DataFrame:
    """Hits of a graph search with payload and citation; the first hit of a query carries its ``graph`` facts.

    Chunks that are no longer in the corpus are skipped before the cut, so they use up no place.
    """
    found = graph_search(graph, batch, settings, top_k, index, search, index.chunks)
    width = top_k or (search or SearchSettings()).top_k
    shown = hits(found.ranked, index.chunks, batch.rows * width)
    facts = found.facts.select("query_id", F.struct(*FACTS).alias("_facts"))
    return (
        shown.join(broadcast_within(facts, batch.rows), "query_id", "left")
        .withColumn("graph", F.when(F.col("rank") == 1, F.col("_facts")))
        .drop("_facts")
    )


def _fallback(batch: QueryBatch, g: GraphSettings, k: int, index: CorpusIndex | None,
              search: SearchSettings) -> GraphResult:
    empty = batch.frame.select(
        "query_id", F.lit(1).alias("rank"), F.lit("").alias("chunk_id"), F.lit(0.0).alias("score")
    ).limit(0)
    ranked = hybrid_search(index, batch, search, top_k=k) if g.fallback_hybrid and index else empty
    facts = batch.frame.select(
        "query_id",
        *[F.lit(0).cast("long").alias(n) for n in FACTS],
    )
    return GraphResult(ranked, facts)
