"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def reciprocal_rank_fusion(
    lists: DataFrame,
    keys: Sequence[str] = ("query_id",),
    item: str = "chunk_id",
    rrf_k: int = 60,
    top: int | None = None,
) -> DataFrame:
    """Fuse rows ``(keys..., list_no, rank, item)`` into ``(keys..., rank, item, score)``.

    ``rank`` is 1-based. An item scores the sum of ``1/(rrf_k + rank)``, added in
    list order; equal scores are ordered by the first list that holds the item,
    then by its rank there. One group holds one item's places, at most one per list.
    """
    fused = lists.groupBy(*keys, item).agg(
        F.array_sort(F.collect_list(F.struct("list_no", "rank"))).alias("_places")
    )
    scored = fused.select(
        *keys,
        item,
        F.aggregate(
            "_places", F.lit(0.0), lambda s, p: s + F.lit(1.0) / (F.lit(rrf_k) + p["rank"])
        ).alias("score"),
        F.get("_places", F.lit(0)).alias("_first"),
    )
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "_first", item)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select(*keys, "rank", item, "score")
