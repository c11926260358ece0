"""Ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import spill


def distributed_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "rank"
) -> DataFrame:
    """1-based position of every row in its group, also for groups larger than one task.

    Rows are range-partitioned by group and order, so a large group spans several
    tasks in sequence. Each row's position is its rank in its own part plus the
    number of the group's rows in earlier parts; only those counts are gathered.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = spill(
        df.repartitionByRange(parts, *[F.col(g) for g in group], *order).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ranked",
    )
    sizes = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = W.partitionBy(*group, "_part").orderBy(*order)
    return (
        placed.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_part", "_local", "_before")
    )
