"""Exact nearest neighbours by dot product, for batches of queries.

Two physical forms give the same rows:

* a query batch within ``MAX_BATCH`` vectors is sent to every task once; each task
  multiplies its vectors with the batch and keeps the best ``k`` per query, so only
  ``tasks * queries * k`` rows are shuffled and the vectors never move;
* a larger batch is cut into query blocks of bounded size that go to the vectors one
  after the other, with one scan each; the vectors do not move here either.

A query with at most ``FEW`` non-zero components is scored from the vectors whose component is large
enough (:mod:`.lists`), instead of a product with all vectors; such queries go out in larger blocks, and equal
vectors are searched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_count, scratch_path, ship_package, spill
from .lists import FEW, SCORE_DIGITS, Best, Lists, _runs
from .sparse import top_by_query

MAX_BATCH = 4096
# How many times more short queries (of at most ``FEW`` components) go out in one block.
SHORT_BLOCKS = 32
# Vectors that a task scores at a time for short queries.
PART = 65_536
_CELLS = 4_000_000


def _matrix(vectors: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), kind)


def block_top(queries: np.ndarray, vectors: np.ndarray, k: int):
    """Indices and rounded scores of the best ``k`` vectors per query, ties by position."""
    n = vectors.shape[0]
    out_q, out_v, out_s = [], [], []
    step = max(1, _CELLS // max(n, 1))
    for lo in range(0, queries.shape[0], step):
        scores = np.round(queries[lo : lo + step] @ vectors.T, SCORE_DIGITS) + 0.0
        if n > k:
            floor = np.partition(scores, n - k, axis=1)[:, n - k]
            q, v = np.nonzero(scores >= floor[:, None])
        else:
            q, v = np.nonzero(np.ones_like(scores, dtype=bool))
        s = scores[q, v]
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < k
        out_q.append(q[keep] + lo)
        out_v.append(v[keep])
        out_s.append(s[keep])
    if not out_q:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


class _Short:
    """Best ``k`` vectors per short query over the parts of a task, ties by name."""

    def __init__(self, queries: np.ndarray, k: int):
        self.k = k
        self.used = np.flatnonzero(queries.any(axis=0))
        width = max(1, int(np.count_nonzero(queries, axis=1).max(initial=0)))
        self.words, self.weights = np.zeros((len(queries), width), np.int64), np.zeros((len(queries), width))
        row, at = np.nonzero(queries[:, self.used])
        cell = row, _runs(row)
        self.words[cell], self.weights[cell] = at, queries[row, self.used[at]]
        # Queries of the same components lie together, and so do the values looked up for them.
        self.order = np.lexsort(self.words.T)
        self.queries, self.words, self.weights = queries[self.order], self.words[self.order], self.weights[self.order]
        self.found = Best(len(queries), k)

    def add(self, names: np.ndarray, vectors: np.ndarray) -> None:
        """A part of vectors, ordered by name."""
        rank = self.found.part(pa.array(names, pa.string()))
        columns = np.ascontiguousarray(vectors[:, self.used].T) if len(self.used) else np.zeros((1, len(vectors)))
        word, place = np.nonzero(columns)
        flat = columns.reshape(-1)
        value_at = lambda w, p: flat[w * len(vectors) + p].astype(np.float64)
        lists = Lists(word, place, value_at(word, place), len(columns), rank, value_at)
        floors = self.found.floors
        q, place, score = lists.best(self.words, self.weights, floors, self.k)
        # Vectors without one of the components score zero; they matter only where positive scores are too few.
        few = (floors <= 0) & (np.bincount(q, minlength=len(self.words)) < self.k)
        keep = ~few[q]
        self.found.take(q[keep], place[keep], score[keep])
        rest = np.flatnonzero(few)
        if len(rest):
            q, place, score = block_top(self.queries[rest], vectors.astype(np.float64), self.k)
            self.found.take(rest[q], place, score)

    @property
    def best(self) -> list[list[tuple[float, str]]]:
        """(negative score, name) per query, best first."""
        out = [[] for _ in self.words]
        for q, names, scores in self.found.rows():
            for number, name, score in zip(self.order[q].tolist(), names.to_pylist(), scores.tolist()):
                out[number].append((-score, name))
        return out


def _merge(best: pd.DataFrame | None, new: pd.DataFrame, k: int) -> pd.DataFrame:
    if best is None:
        return new
    both = pd.concat([best, new], ignore_index=True)
    both = both.sort_values(["q", "score", "item"], ascending=[True, False, True])
    return both[both.groupby("q").cumcount() < k]


def dense_topk(
    vectors: DataFrame, queries: DataFrame, k: int, item: str = "chunk_id",
    max_batch: int = MAX_BATCH,
) -> DataFrame:
    """Rows ``(query_id, rank, item, score)`` with the ``k`` best items per query."""
    ship_package(vectors.sparkSession)
    batch = queries.select("query_id", "vector").limit(max_batch + 1).toArrow()
    if batch.num_rows <= max_batch:
        ranked = top_by_query(_by_batch(vectors, batch, k, item), k, item, parts=1)
    else:
        ranked = _by_blocks(vectors, queries, k, item, max_batch)
    return ranked.select("query_id", "rank", item, "score")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names and vectors of about ``PART`` rows at a time, ordered by name."""
    held, count = [], 0

    def part() -> tuple[np.ndarray, np.ndarray]:
        names = np.array([n for b in held for n in b.column(0).to_pylist()], dtype=object)
        order = np.argsort(names, kind="stable")
        kind = np.float32 if held[0].column(1).type.value_type == pa.float32() else np.float64
        return names[order], np.concatenate([_matrix(b.column(1), kind) for b in held])[order]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= PART:
            yield part()
            held, count = [], 0
    if held:
        yield part()


def _by_batch(vectors: DataFrame, batch: pa.Table, k: int, item: str) -> DataFrame:
    ids = batch.column("query_id").to_pylist()
    matrix = _matrix(batch.column("vector"))
    short = bool(ids) and k > 0 and bool((np.count_nonzero(matrix, axis=1) <= FEW).all())
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)
    named = pa.array(ids, pa.string())

    def rows(names, items, scores) -> pa.RecordBatch:
        plain = lambda x: x if isinstance(x, pa.Array) else pa.array(x, pa.string())
        return pa.RecordBatch.from_arrays(
            [plain(names), plain(items), pa.array(scores, pa.float64())],
            names=["query_id", item, "score"],
        )

    def scan_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Short(shared.value, k)
        for names, part in _parts(batches):
            found.add(names, part)
        for q, items, scores in found.found.rows():
            yield rows(named.take(pa.array(found.order[q])), items, scores)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        if ids:
            for part in batches:
                if part.num_rows == 0:
                    continue
                names = np.array(part.column(0).to_pylist(), dtype=object)
                order = np.argsort(names, kind="stable")
                q, v, s = block_top(shared.value, _matrix(part.column(1))[order], k)
                new = pd.DataFrame({"q": q, "item": names[order][v], "score": s})
                best = _merge(best, new, k)
        if best is not None and len(best):
            yield rows([ids[i] for i in best["q"]], list(best["item"]), best["score"].to_numpy())

    return vectors.select(F.col(item).cast("string"), "vector").mapInArrow(
        scan_short if short else scan, f"query_id string, {item} string, score double"
    )


def query_blocks(queries: DataFrame, max_batch: int) -> Iterator[DataFrame]:
    """The queries in blocks by hash of their id, about half of ``max_batch`` rows each."""
    stored = spill(queries.select("query_id", "vector"), "asked")
    blocks = math.ceil(2 * stored.count() / max_batch)
    for i in range(blocks):
        yield stored.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)


def _by_blocks(vectors: DataFrame, queries: DataFrame, k: int, item: str, max_batch: int) -> DataFrame:
    """One scan of the vectors per query block; each block's best rows are written before the next one.

    Queries with equal vectors have equal rows: one of them is searched, the others get its rows.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "dense-blocks")
    sized = spill(
        queries.groupBy("vector").agg(F.collect_list(F.struct("query_id")).alias("ids")).select(
            F.monotonically_increasing_id().cast("string").alias("query_id"), "vector", "ids",
            (F.size(F.filter("vector", lambda x: x != 0)) <= FEW).alias("_short"),
        ),
        "asked",
    )
    for short, width in ((True, SHORT_BLOCKS * max_batch), (False, max_batch)):
        for block in query_blocks(sized.filter(F.col("_short") == short), width):
            part = _by_batch(vectors, block.toArrow(), k, item)
            top_by_query(part, k, item, parts=1).write.mode("append").parquet(path)
    found = spark.read.schema(f"query_id string, {item} string, score double, rank int").parquet(path)
    who = sized.select("query_id", F.explode("ids").alias("who"))
    return found.join(who, "query_id").select(F.col("who.query_id").alias("query_id"), "rank", item, "score")


def dense_moments(vectors: DataFrame, queries: DataFrame, max_batch: int = MAX_BATCH) -> DataFrame:
    """Per query the mean and population deviation of the scores over all vectors.

    Each task gives one row of count, sum and sum of squares per query. A batch of more
    than ``max_batch`` queries is dealt to blocks by hash, with one scan of the vectors each.
    """
    ship_package(vectors.sparkSession)
    stored = queries.select("query_id", "vector")
    if bounded_count(stored, max_batch) is not None:
        return _moments(vectors, stored)
    out = None
    for block in query_blocks(stored, max_batch):
        part = _moments(vectors, block)
        out = part if out is None else out.unionByName(part)
    return out


def _moments(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """:func:`dense_moments` of one block of queries."""
    batch = queries.toArrow()
    ids = batch.column("query_id").to_pylist()
    shared = vectors.sparkSession.sparkContext.broadcast(_matrix(batch.column("vector")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(len(ids)), np.zeros(len(ids))
        for part in batches:
            if part.num_rows and ids:
                scores = shared.value @ _matrix(part.column(0)).T
                n += part.num_rows
                total += scores.sum(axis=1)
                square += (scores * scores).sum(axis=1)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()),
                    pa.array([n] * len(ids), pa.int64()),
                    pa.array(total),
                    pa.array(square),
                ],
                names=["query_id", "n", "total", "square"],
            )

    parts = vectors.select("vector").mapInArrow(
        scan, "query_id string, n long, total double, square double"
    )
    sums = parts.groupBy("query_id").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square")
    )
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("square") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("query_id", mean.alias("mean"), spread.alias("sd"))
