"""Optional reordering of fused hits by a pair scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import search_tokens
from ..session import broadcast_within, ship_package

_SCORERS: dict[str, Callable[[list[tuple[str, str]]], list[float]]] = {}


def register_reranker(name: str, score: Callable[[list[tuple[str, str]]], list[float]]) -> None:
    """Plug in a scorer of (question, text) pairs; it runs on Arrow batches."""
    _SCORERS[name] = score


def _cross_encoder(name: str):
    try:
        from sentence_transformers import CrossEncoder
    except ImportError:
        return None
    return CrossEncoder(name).predict


def rerank_hits(
    ranked: DataFrame, queries: DataFrame, chunks: DataFrame, model: str, bound: int
) -> DataFrame:
    """Replace scores by pair scores and rank anew; equal scores keep their order.

    Without a scorer for ``model`` the order stays as it is.
    """
    scorer = _SCORERS.get(model)
    if scorer is None and model != "token-overlap" and _cross_encoder(model) is None:
        return ranked
    ship_package(chunks.sparkSession)
    pairs = chunks.select("chunk_id", "text").join(
        broadcast_within(ranked, bound), "chunk_id"
    ).join(queries.select("query_id", "question"), "query_id")
    if scorer is None and model == "token-overlap":
        score = _overlap(F.col("question"), F.col("text"))
    else:
        score = _pair_udf(model, scorer)(F.col("question"), F.col("text"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "_before")
    return (
        pairs.select("query_id", "chunk_id", F.col("rank").alias("_before"), score.alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .select("query_id", "rank", "chunk_id", "score")
    )


def _overlap(question: F.Column, text: F.Column) -> F.Column:
    """Share of the question's distinct words found in the text."""
    asked = F.array_distinct(search_tokens(question))
    shared = F.size(F.array_intersect(asked, search_tokens(text)))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(shared / F.size(asked))


def _pair_udf(model: str, scorer):
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fn = scorer or _cross_encoder(model)
        for question, text in batches:
            yield pd.Series([float(s) for s in fn(list(zip(question, text.fillna(""))))])

    return score
