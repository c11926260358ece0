"""Near-duplicate embeddings by cross-polytope hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spill
from .components import components
from .simhash import _join_groups, _with_end

COSINE = 0.95
TABLES = 6
# Polytopes whose vertices together name a bucket.
POLYTOPES = 2
# Buckets that a vector is looked for beside its own, in each table.
PROBES = 4
SEED = 11
# Rows of a bucket that are compared in one piece.
PIECE = 2048


# Hashing


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


@lru_cache(maxsize=8)
def _signs(width: int, tables: int, polytopes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, polytopes, 3, width))


def buckets(unit: np.ndarray, tables: int, polytopes: int, probes: int, seed: int) -> np.ndarray:
    """(row, table, 1 + probes) bucket numbers; the first is the vector's own, the others the next nearest.

    Each polytope rotates the vector by three rounds of random signs and a Hadamard
    transform and takes the nearest of its vertices. A probe takes other vertices, by
    the least sum of squared distances lost; -1 stands where a short vector has no more of them.
    """
    n, dims = unit.shape
    width = max(2, 1 << (dims - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :dims] = unit
    signs = _signs(width, tables, polytopes, seed)
    near = min(4, width)
    out = np.full((n, tables, 1 + probes), -1, np.int64)
    for t in range(tables):
        cost, code = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for p in range(polytopes):
            turned = padded
            for s in signs[t, p]:
                turned = _hadamard(turned * s)
            size = np.abs(turned)
            best = np.argsort(-size, axis=1, kind="stable")[:, :near]
            top = np.take_along_axis(size, best, 1)
            vertex = 2 * best + (np.take_along_axis(turned, best, 1) < 0)
            cost = (cost[:, :, None] + ((top[:, :1] - top) ** 2)[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] * (2 * width) + vertex[:, None, :]).reshape(n, -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        out[:, t, : order.shape[1]] = np.take_along_axis(code, order, 1)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) for each length of vector in a list column."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[starts[rows][:, None] + np.arange(size)]))
    return out


# Comparison in buckets


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two vectors meet in a table: own bucket first, probes after it."""
    return (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)


def _owned(codes: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Pairs that count here: they meet in no earlier table, and in no smaller bucket of this one."""
    keep = np.ones(len(a), bool)
    for t in range(table):
        keep &= ~_meet(codes[a, t], codes[b, t])
    own_a, own_b = codes[a, table, 0], codes[b, table, 0]
    in_a = (codes[b, table] == own_a[:, None]).any(axis=1) & (own_a < bucket)
    in_b = (codes[a, table] == own_b[:, None]).any(axis=1) & (own_b < bucket)
    return keep & ~in_a & ~in_b


def _compare(unit, own, side, hashing, table: int, bucket: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket that are linked and count here; one of each has the bucket as its own.

    ``side`` is the piece a row stands for (both pieces are compared), or -1 if the bucket is whole.
    """
    homes = np.flatnonzero(own)
    for start in range(0, len(unit), PIECE):
        part = unit[start : start + PIECE]
        a, b = np.nonzero(part @ unit[homes].T >= cosine)
        a, b = a + start, homes[b]
        once = (a < b) | (~own[a] & (a != b))
        if side[0] >= 0:
            once &= side[a] != side[b]
        a, b = a[once], b[once]
        if len(a):
            rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            codes = buckets(unit[rows], *hashing)  # of the linked rows alone, so that rows need not carry them
            keep = _owned(codes, at[: len(a)], at[len(a) :], table, bucket)
            yield a[keep], b[keep]


def _search(batches: Iterator[pa.RecordBatch], hashing: tuple, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, first, second); gives for each vector its links found here and its group's first."""
    held = None
    for batch in _with_end(batches):
        now = pa.Table.from_batches([batch]) if batch is not None else None
        rows = pa.concat_tables([t for t in (held, now) if t is not None]) if held is not None or now is not None else None
        if rows is None or not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        keys = [rows.column(c).to_numpy() for c in ("table", "bucket", "dims", "first", "second")]
        new = np.zeros(rows.num_rows - 1, bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [rows.num_rows]] if batch is None else [[0], np.flatnonzero(new) + 1])
        found = [np.empty(0, np.int64)] * 3
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end - start < 2:
                continue
            group = rows.slice(start, end - start)
            own = np.asarray(group.column("own").to_numpy(zero_copy_only=False), bool)
            if not own.any():
                continue
            (_, unit), = _matrix(group.column("embedding").combine_chunks())
            first, second = int(keys[3][start]), int(keys[4][start])
            side = group.column("piece").to_numpy() if first != second else np.full(len(own), -1)
            label, links = np.arange(len(own)), np.zeros(len(own), np.int64)
            weight = group.column("n").to_numpy()
            for a, b in _compare(_unit(unit), own, side, hashing, int(keys[0][start]), int(keys[1][start]), cosine):
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                label = _join_groups(label, a, b)
            hit = links > 0
            key = group.column("key").to_numpy()
            found = [np.concatenate([x, y]) for x, y in zip(found, (key[hit], links[hit], key[label[hit]]))]
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "links", "head"])
        held = rows.slice(cuts[-1]) if batch is not None else None


def _usable(vector: Column) -> Column:
    """A vector that has a direction: components present and finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def linked_vectors(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    tables: int = TABLES,
    polytopes: int = POLYTOPES,
    probes: int = PROBES,
    seed: int = SEED,
    piece: int = PIECE,
) -> DataFrame:
    """One row per row of ``table``: id, ``n_links``, ``component_id``, ``kept``.

    Equal vectors are one point with a count. Every point stands in its own bucket of each
    table and in ``probes`` further ones; rows meet where one of them has the bucket as its own. A bucket of
    more than ``piece`` rows is dealt in pieces, each two of which are compared in a task of
    their own. A pair is counted only in the first place where it meets, so links are added
    up without writing pairs out; for components each bucket gives one link per point.
    Cosines are taken in double precision from the vectors themselves. Recall is that of the
    hashing (measured in the tests); pairs below ``cosine`` never count. For far more
    vectors raise ``polytopes`` (buckets grow as (2 * width) ** polytopes) and ``tables``.

    Vectors that are null, empty, zero or hold null or non-finite components have no links
    and are components of their own (their id). Vectors of different lengths have no links.
    Rows with equal ids are each a row; a component's id is its smallest id that is not
    null. ``kept`` is whether the id equals it (true for a null id without others). An
    empty table gives an empty result.
    """
    spark = table.sparkSession
    ship_package(spark)
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    rows = rows.withColumn("fine", _usable(F.col("embedding")))
    points = spill(
        rows.where("fine").groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        .withColumn("key", F.monotonically_increasing_id()),
        "points",
    )

    def sign(batches):
        for batch in batches:
            out = np.empty(batch.num_rows, object)
            for at, matrix in _matrix(batch.column(2)):
                codes = buckets(_unit(matrix), tables, polytopes, probes, seed)
                for i, row in zip(at, codes.reshape(len(at), -1)):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.int64()))], ["key", "n", "embedding", "codes"])

    vector_type = points.schema["embedding"].dataType.simpleString()
    signed = points.select("key", "n", "embedding").mapInArrow(
        sign, f"key long, n long, embedding {vector_type}, codes array<long>"
    )
    width = 1 + probes
    places = F.transform(
        F.col("codes"),
        lambda code, i: F.struct(
            F.floor(i / width).cast("int").alias("table"), code.alias("bucket"), (i % width == 0).alias("own")
        ),
    )
    placed = (
        signed.select("key", "n", "embedding", F.size("embedding").alias("dims"), F.explode(places).alias("place"))
        .where("place.bucket >= 0")
        .select("place.table", "place.bucket", "dims", "place.own", "key", "n", "embedding")
    )
    slot = ["table", "bucket", "dims"]
    sizes = placed.groupBy(*slot).agg(F.count("*").alias("rows"), F.max("own").alias("home")).where("rows > 1 AND home")
    dealt = (
        placed.join(sizes.select(*slot, "rows"), slot)
        .withColumn("pieces", F.ceil(F.col("rows") / piece).cast("int"))
        .withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(
            *slot, F.least("piece", "other").alias("first"), F.greatest("piece", "other").alias("second"), "piece",
            "own", "key", "n", "embedding",
        )
    )
    order = [*slot, "first", "second"]
    found = spill(
        dealt.repartition(*order).sortWithinPartitions(*order, "key").mapInArrow(
            lambda batches: _search(batches, (tables, polytopes, probes, seed), cosine), "key long, links long, head long"
        ),
        "links",
    )
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    of = components(found.where("key <> head"), "key", "head").withColumnRenamed("node", "key")
    classed = spill(
        points.select("key", "least", "n", "embedding")
        .join(links, "key", "left").join(of, "key", "left")
        .select("key", "least", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "key").alias("class")),
        "classes",
    )
    heads = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classed.join(heads, "class").select("embedding", "n_links", "component_id")
    joined = rows.where("fine").join(named, "embedding").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
