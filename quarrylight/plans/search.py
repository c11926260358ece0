"""Hybrid search over batches of queries: dense and sparse arms, fused by rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..operators.blocks import pruned_topk
from ..operators.dense import dense_topk
from ..operators.embed import embed
from ..operators.fusion import reciprocal_rank_fusion
from ..operators.rerank import rerank_hits
from ..operators.router import classify_queries
from ..operators.sparse import query_terms
from ..recipe import SearchSettings
from ..session import broadcast_within, spill
from .index import CorpusIndex

OVERFETCH = 4


@dataclass(frozen=True)
class QueryBatch:
    """Rows ``(query_id, question)`` with a proven bound on their number."""

    frame: DataFrame
    rows: int

    @staticmethod
    def of(queries: DataFrame) -> QueryBatch:
        """Materialise the queries once in shared storage and count them."""
        stored = spill(queries.select("query_id", "question"), "queries")
        return QueryBatch(stored, stored.count())

    @staticmethod
    def bounded(queries: DataFrame, rows: int) -> QueryBatch:
        """For queries whose plan already limits them to ``rows``."""
        return QueryBatch(queries.select("query_id", "question"), rows)


def plan_widths(
    index: CorpusIndex, batch: QueryBatch, settings: SearchSettings,
    top_k: int | None = None, route: bool | None = None,
) -> tuple[DataFrame, int, int]:
    """Queries with vector, ``candidate_k`` and ``top_k`` columns, and both upper bounds.

    The candidate width is four times the width asked for. A query routed as global
    gets a deeper pool, and a wider result only when no width was asked for. A routed plan is
    written once; hand it on as ``planned`` where several steps need it.
    """
    base_k = settings.top_k if top_k is None else top_k
    candidate = max(OVERFETCH * base_k, base_k)
    queries = embed(batch.frame, "question", index.model)
    routed = settings.routing_enabled if route is None else route
    if not routed:
        return (
            queries.withColumns(
                {
                    "candidate_k": F.lit(candidate),
                    "top_k": F.lit(base_k),
                    "scope": F.lit(None).cast("string"),
                    "method": F.lit(None).cast("string"),
                    "route_score": F.lit(None).cast("double"),
                }
            ),
            candidate,
            base_k,
        )
    wide = F.col("scope") == "global"
    wide_k = settings.global_top_k if top_k is None else base_k
    plan = classify_queries(queries, index.model, settings.routing_margin).withColumns(
        {
            "candidate_k": F.when(
                wide, F.greatest(F.lit(candidate), F.lit(settings.global_candidate_k))
            ).otherwise(F.lit(candidate)),
            "top_k": F.when(wide, F.lit(wide_k)).otherwise(F.lit(base_k)),
        }
    )
    return spill(plan, "plan"), max(candidate, settings.global_candidate_k), max(base_k, wide_k)


def sparse_arm(index: CorpusIndex, batch: QueryBatch, top: int) -> DataFrame:
    """BM25 candidates; an index without postings gives no rows."""
    if not index.stats or not index.stats["n_tokens"]:
        return batch.frame.select(
            "query_id", F.lit(1).alias("rank"), F.lit("").alias("chunk_id"), F.lit(0.0).alias("score")
        ).limit(0)
    found = pruned_topk(
        query_terms(batch.frame), index.table("shards"), index.table("term_stats"),
        index.stats["n_chunks"], index.average_length, top,
    )
    return found.select("query_id", "rank", "chunk_id", "score")


def pruning_report(index: CorpusIndex, batch: QueryBatch, top: int) -> DataFrame:
    """Per query: blocks and postings of its words, and how many of them are opened."""
    return pruned_topk(
        query_terms(batch.frame), index.table("shards"), index.table("term_stats"),
        index.stats["n_chunks"], index.average_length, top, report=True,
    )


def hybrid_search(
    index: CorpusIndex, batch: QueryBatch, settings: SearchSettings | None = None,
    top_k: int | None = None, route: bool | None = None, rerank: bool = False,
    planned: tuple[DataFrame, int, int] | None = None,
) -> DataFrame:
    """Rows ``(query_id, rank, chunk_id, score)``, best first. ``planned`` is a result of :func:`plan_widths`.

    Ranks past a query's own width are cut by column; the constant upper bound
    beside it lets Spark prune each task's rows before the shuffle.
    """
    settings = settings or SearchSettings()
    plan, max_candidates, max_top = planned or plan_widths(index, batch, settings, top_k, route)
    widths = plan.select("query_id", "candidate_k", "top_k")
    dense = dense_topk(index.table("vectors"), plan.select("query_id", "vector"), max_candidates)
    sparse = sparse_arm(index, batch, max_candidates)
    arms = dense.select("query_id", "rank", "chunk_id", F.lit(0).alias("list_no")).unionByName(
        sparse.select("query_id", "rank", "chunk_id", F.lit(1).alias("list_no"))
    )
    routed = settings.routing_enabled if route is None else route
    if routed:
        arms = arms.join(broadcast_within(widths, batch.rows), "query_id").filter(
            F.col("rank") <= F.col("candidate_k")
        )
    again = rerank or settings.rerank_enabled
    fused = reciprocal_rank_fusion(arms, rrf_k=settings.rrf_k, top=None if again else max_top)
    if again:
        fused = rerank_hits(
            fused, batch.frame, index.chunks, settings.rerank_model, batch.rows * max_candidates * 2
        )
    if routed:
        fused = fused.join(broadcast_within(widths, batch.rows), "query_id").filter(
            F.col("rank") <= F.col("top_k")
        )
    return fused.filter(F.col("rank") <= max_top).select("query_id", "rank", "chunk_id", "score")


def hits(ranked: DataFrame, chunks: DataFrame, bound: int | None = None) -> DataFrame:
    """Ranked ids with chunk payload and citation; ids missing from the corpus drop out."""
    payload = chunks.select(
        "chunk_id",
        "doc_id",
        "text",
        "kind",
        F.coalesce("section_path", F.array().cast("array<string>")).alias("section_path"),
        F.when(F.col("page") >= 0, F.col("page")).alias("page"),
        blank_to_null(F.col("artifact_id")).alias("artifact_id"),
    )
    found = payload.join(broadcast_within(ranked, bound), "chunk_id")
    extra = [c for c in ranked.columns if c != "chunk_id"]
    return found.select(
        *extra,
        F.struct(
            "chunk_id", "doc_id", "text", "kind", "section_path", "page", "artifact_id"
        ).alias("chunk"),
        F.struct("doc_id", "chunk_id", "section_path", "page", "artifact_id").alias("citation"),
    )


def search_hits(
    index: CorpusIndex, batch: QueryBatch, settings: SearchSettings | None = None,
    top_k: int | None = None, route: bool | None = None, rerank: bool = False,
) -> DataFrame:
    """Hits with payload; the first hit of a routed query carries its routing facts."""
    settings = settings or SearchSettings()
    planned = plan_widths(index, batch, settings, top_k, route)
    ranked = hybrid_search(index, batch, settings, top_k, route, rerank, planned)
    width = max(settings.top_k if top_k is None else top_k, settings.global_top_k)
    found = hits(ranked, index.chunks, batch.rows * max(width, 1))
    if not (settings.routing_enabled if route is None else route):
        return found.withColumn("route", F.lit(None).cast(ROUTE))
    facts = planned[0].select(
        "query_id",
        F.struct(
            "scope", "method", F.col("route_score").alias("score"), "candidate_k",
            F.col("top_k").alias("returned_top_k"),
        ).alias("_route"),
    )
    return (
        found.join(broadcast_within(facts, batch.rows), "query_id")
        .withColumn("route", F.when(F.col("rank") == 1, F.col("_route")))
        .drop("_route")
    )


ROUTE = "struct<scope:string,method:string,score:double,candidate_k:int,returned_top_k:int>"
