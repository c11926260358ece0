"""Near-duplicate documents by SimHash fingerprints, searched with BK-trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spill
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
# Fingerprints of one shard beyond which it is divided by more of their bits.
SHARD = 1024
# Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20
# Pairs of a query and a tree node that are looked at together.
FRONT = 1 << 22

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


# Fingerprints


def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, block by block."""
    start = 0
    while start < len(data):
        gap = _SPACE.search(data, start + BLOCK)
        end = gap.start() if gap else len(data)
        yield data[start:end].lower().split()
        start = end


def fingerprint(data: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of all word shingles of a UTF-8 text, as an unsigned 64-bit number."""
    total, bits, tail, seen = 0, np.zeros(64, np.int64), [], 0
    digest = xxhash.xxh64_intdigest
    for words in _word_blocks(data or b""):
        seen += len(words)
        words = tail + words
        if len(words) >= shingle:
            runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            hashes = np.fromiter((digest(r, seed) for r in runs), np.uint64, len(words) - shingle + 1)
            for at in range(0, len(hashes), 1 << 15):
                part = hashes[at : at + (1 << 15)]
                bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
            total += len(hashes)
            words = words[len(words) - shingle + 1 :]
        tail = words
    if not total and seen:
        return digest(b" ".join(tail), seed)
    return int(np.packbits(2 * bits > total, bitorder="little").view(np.uint64)[0]) if total else 0


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint of a text as a signed long; null and empty texts have 0."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return of(text.cast("binary"))


# BK-trees


class BkTree:
    """A tree over distinct fingerprints; a node's children are keyed by their distance to it."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.child = np.full((len(points), 65), -1, np.int32)
        slots = self.child.reshape(-1)
        rest = np.arange(1, len(points))
        at = np.zeros(len(rest), np.int64)
        while rest.size:  # all points go down one level at a time; the first at a free edge stays there
            edge = at * 65 + np.bitwise_count(points[rest] ^ points[at])
            free, first = np.unique(edge, return_index=True)
            slots[free] = rest[first]
            at = slots[edge].astype(np.int64)
            moving = at != rest
            at, rest = at[moving], rest[moving]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query number, point number) at most ``radius`` bits apart."""
        query, node, found = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
        while query.size:
            gap = np.bitwise_count(queries[query] ^ self.points[node]).astype(np.int64)
            near = gap <= radius
            found.append((query[near], node[near]))
            ways = []
            for step in range(-radius, radius + 1):  # a match lies only below these edges
                edge = gap + step
                fits = (edge >= 0) & (edge <= 64)
                child = self.child[node[fits], edge[fits]]
                ways.append((query[fits][child >= 0], child[child >= 0].astype(np.int64)))
            query, node = (np.concatenate(x) for x in zip(*ways))
        return tuple(np.concatenate(x) for x in zip(*found))


def _join_groups(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest number of a group) after linking ``a`` with ``b``."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def shard_groups(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct fingerprints of a shard, the number of the first one of each one's group."""
    label = np.arange(len(points))
    tree = BkTree(points)
    block = max(1, FRONT // len(points))
    for start in range(0, len(points), block):
        query, node = tree.within(points[start : start + block], radius)
        label = _join_groups(label, query + start, node)
    return label


def _search_shards(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, fp) sorted by shard and part; gives links to the first of each group."""
    held = [np.empty(0, np.int64)] * 3
    for batch in _with_end(batches):
        if batch is None:
            rows, cuts = held, np.array([0, len(held[0])])
        else:
            rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            new = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(rows[0]) else np.array([0])
        fps = rows[2].view(np.uint64)
        a, b = [], []
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end - start == 2:  # a root and one child
                if int(fps[start] ^ fps[start + 1]).bit_count() <= radius:
                    a.append(fps[start + 1 : end])
                    b.append(fps[start : start + 1])
            elif end - start > 2:
                label = shard_groups(fps[start:end], radius)
                moved = label != np.arange(len(label))
                a.append(fps[start:end][moved])
                b.append(fps[start:end][label[moved]])
        held = [r[cuts[-1] :] for r in rows]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def _with_end(items: Iterator) -> Iterator:
    yield from items
    yield None


def _pairs_of_blocks(value: Column, width: int) -> Column:
    """All ways to take 2 of 4 blocks of a value's lowest ``4 * width`` bits, as numbers."""
    mask = F.lit((1 << width) - 1).cast("long")
    block = [F.shiftrightunsigned(value, width * i).bitwiseAND(mask) for i in range(4)]
    ways = [
        F.lit(n << (2 * width)).cast("long").bitwiseOR(F.shiftleft(block[i], width)).bitwiseOR(block[j])
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ]
    return F.array(*ways)


def _rest_of(fp: Column, way: Column) -> Column:
    """The two 16-bit blocks of a fingerprint that a way leaves out, as 32 bits."""
    mask = F.lit(0xFFFF).cast("long")
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(mask) for i in range(4)]
    out = F.lit(None).cast("long")
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        out = F.when(way == n, F.shiftleft(block[k], 16).bitwiseOR(block[m])).otherwise(out)
    return out


def fingerprint_links(fps: DataFrame, column: str = "fp", shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at most two bits apart.

    Two fingerprints that differ in two bits at most agree in two of four 16-bit blocks.
    Each way to take two blocks deals the fingerprints to shards, so whatever links meets in
    a shard and no tree has to see the others. A shard larger than ``shard`` is dealt again
    by pairs of the 8-bit blocks of its other 32 bits; then 48 bits are equal and a tree has
    65,536 points at most. Every shard's tree goes only to the task that has the shard's
    queries: a broadcast of all trees would grow with the data. A tree gives one
    link per fingerprint, to the first of its group, never all pairs.
    """
    ship_package(fps.sparkSession)
    keys = fps.select(F.col(column).alias("fp")).distinct().select(
        "fp", F.explode(_pairs_of_blocks(F.col("fp"), 16)).alias("shard")
    )
    sizes = keys.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keys.join(sizes, "shard").withColumn(
        "part",
        F.when(F.col("n") <= shard, F.array(F.lit(-1).cast("long"))).otherwise(
            _pairs_of_blocks(_rest_of(F.col("fp"), F.shiftrightunsigned("shard", 32)), 8)
        ),
    ).select("shard", F.explode("part").alias("part"), "fp")
    placed = dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "fp")

    def search(batches):
        return _search_shards(batches, RADIUS)

    return placed.mapInArrow(search, "a long, b long").distinct()


def _classes(marked: DataFrame) -> DataFrame:
    """(fp, class) for every fingerprint of ``marked``."""
    of = components(fingerprint_links(marked), "a", "b").withColumnRenamed("node", "fp")
    return marked.select("fp").distinct().join(of, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("class")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed long), ``component_id``.

    Null and empty texts, and texts of white space, have the fingerprint zero and link like any other.
    ``component_id`` is the smallest id that is not null among the rows reachable; null if all
    are null. Repeated rows give repeated results. Only the two named columns are read. An
    empty table gives an empty result. A fingerprint that very many rows share is one point.
    """
    ship_package(docs.sparkSession)
    marked = spill(
        docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints"
    )
    least = marked.groupBy("fp").agg(F.min("id").alias("id"))
    classes = spill(_classes(marked), "classes")
    heads = classes.join(least, "fp").groupBy("class").agg(F.min("id").alias("component_id"))
    named = classes.join(heads, "class").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay: of each group that with the smallest id (null last, then by text hash).

    Rows with equal id and text count as one row. All columns are kept.
    """
    ship_package(docs.sparkSession)
    row = lambda d: [F.xxhash64(F.lit(n), d[id_col], d[text_col]) for n in (1, 2)]
    first, second = row(docs)
    marked = spill(
        docs.select(
            docs[id_col].alias("id"), fingerprint_column(docs[text_col]).alias("fp"), first.alias("r1"), second.alias("r2")
        ),
        "fingerprints",
    )
    order = F.struct(F.col("id").isNull().alias("late"), F.col("id"), F.col("r1"), F.col("r2"))
    least = marked.groupBy("fp").agg(F.min(order).alias("head"))
    heads = _classes(marked).join(least, "fp").groupBy("class").agg(F.min("head").alias("head"))
    winners = spill(heads.select(F.col("head.r1").alias("__row_1"), F.col("head.r2").alias("__row_2")), "kept")
    first, second = row(docs)
    once = docs.withColumn("__row_1", first).withColumn("__row_2", second).dropDuplicates(["__row_1", "__row_2"])
    return once.join(winners, ["__row_1", "__row_2"], "left_semi").drop("__row_1", "__row_2")
