"""Distributed union-find over link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spill


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge table."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    return tuple(row)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select("v", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the smallest node around it."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of ``links``; component is its smallest node.

    Alternating star rounds: each is a min-aggregate (combined before its shuffle) joined
    back to the edges, so a node with very many links is split over tasks. A round's
    edges are written to the shared folder; the rounds end when the edge set stays the
    same, which is the star of every component. Links from a node to itself yield the
    node alone; links with a null end are ignored. An empty table gives an empty result.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    lone = pairs.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    edges = spill(pairs.where("u <> v").distinct(), "links")
    before = None
    now = _state(edges)
    while now[0] and now != before:
        edges = spill(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        before, now = now, _state(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.union(heads).union(lone).groupBy("node").agg(F.min("component").alias("component"))
