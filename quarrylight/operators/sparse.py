"""BM25 over a postings table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import search_tokens
from ..session import BROADCAST_ROWS, bounded_count, broadcast_within, spill

K1 = 1.2
B = 0.75
# Parts of a query's items that are ranked apart before the final ranking.
TOP_PARTS = 16


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct words per query."""
    words = F.array_distinct(search_tokens(F.col("question")))
    return queries.select("query_id", F.explode_outer(words).alias("term")).filter(
        F.col("term").isNotNull()
    )


def inverse_frequency(df: Column, n_chunks: int) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(n_chunks)) - df + 0.5) / (df + 0.5))


def bm25_scores(
    terms: DataFrame, postings: DataFrame, term_stats: DataFrame, n_chunks: int, avg_len: float
) -> DataFrame:
    """Rows ``(query_id, chunk_id, score)`` for every chunk that shares a term; no block is skipped.

    For the best few chunks use :func:`quarrylight.operators.blocks.pruned_topk`.

    The weighted query terms are written and counted first. Within the broadcast
    limit they go to the postings, which then do not move; beyond it the join
    shuffles and AQE may split a skewed term. Scores are pre-added per task before
    the shuffle by chunk.
    """
    weighted = spill(
        terms.join(term_stats, "term").select(
            "query_id",
            "term",
            inverse_frequency(F.col("df"), n_chunks).alias("idf"),
        ),
        "query_terms",
    )
    bound = bounded_count(weighted, BROADCAST_ROWS)
    tf = F.col("tf").cast("double")
    saturation = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(float(avg_len))))
    return (
        postings.join(broadcast_within(weighted, bound), "term")
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(F.col("idf") * saturation), 6).alias("score"))
    )


def top_by_query(scores: DataFrame, top: int, item: str = "chunk_id", parts: int = TOP_PARTS) -> DataFrame:
    """Rank by score, ties by id, in two levels.

    Both limits are applied per task before their shuffle. The first level ranks a query's items in
    ``parts`` parts by hash, so no reduce key gets more than the tasks' best of one part; the second
    ranks at most ``parts * top`` rows per query. With one part there is the second level alone, for
    rows that are already each task's best.
    """
    order = [F.desc("score"), F.col(item)]
    best = scores
    if parts > 1:
        part = F.pmod(F.xxhash64(item), F.lit(parts))
        first = F.row_number().over(W.partitionBy("query_id", "_part").orderBy(*order))
        best = scores.withColumn("_part", part).withColumn("_place", first).filter(F.col("_place") <= top).drop("_part", "_place")
    last = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return best.withColumn("rank", last).filter(F.col("rank") <= top)
