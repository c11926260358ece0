"""Text vectors with meaning: a truncated singular value decomposition of the tf-idf matrix, found by randomised block power iteration.

The matrix of chunks and words stays in parts of the cluster, the block of word vectors in row blocks. A round multiplies each
part with the word block and its transpose, adds the parts' results, and makes the sum orthonormal by a QR
decomposition of tall blocks. The driver only ever sees matrices of ``width`` by ``width``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import search_tokens
from ..session import broadcast_within, ship_package, spill

DIMENSIONS = 64
# Vectors carried beside the ones asked for, and rounds of power iteration.
EXTRA = 16
ROUNDS = 6
# Words with a column of their own: the most frequent ones that stand in at least two chunks.
VOCABULARY = 20_000
MIN_DF = 2
# Words in a row block, and chunks in a part, which bound what a task holds.
BLOCK = 1024
PART = 50_000
SEED = 11

_PIECES = "block long, data binary"


def weights(count: Column, df: Column, n_chunks: int) -> Column:
    """Weight of a word in a chunk before scaling: log count times inverse frequency."""
    return (1 + F.log(count.cast("double"))) * F.log((F.lit(float(n_chunks)) + 1) / (df + 1))


def vocabulary(term_stats: DataFrame, n_chunks: int, size: int = VOCABULARY, min_df: int = MIN_DF) -> DataFrame:
    """(term, df, column) of the ``size`` most frequent words below all chunks, ties by word; columns from 0."""
    kept = term_stats.filter((F.col("df") >= min_df) & (F.col("df") < n_chunks)).select("term", "df")
    kept = kept.orderBy(F.desc("df"), "term").limit(size)
    return kept.withColumn("column", F.row_number().over(W.orderBy(F.desc("df"), "term")) - 1)


def tfidf(terms: DataFrame, words: DataFrame, n_chunks: int, bound: int = VOCABULARY) -> DataFrame:
    """(chunk_id, term, column, weight): rows of length one per chunk; chunks without a known word are left out.

    ``terms`` has (chunk_id, terms: counted words). ``words`` is bounded and goes to the chunks. Chunks meet by id as
    whole rows, which are a fraction of their entries' size; a chunk's entries are made and summed in its task.
    """
    packed = terms.select("chunk_id", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["n"].alias("n"))).alias("terms"))
    entries = packed.repartition("chunk_id").select("chunk_id", F.explode("terms").alias("t")).select("chunk_id", "t.term", F.col("t.n").alias("n"))
    raw = entries.join(broadcast_within(words, bound), "term").withColumn("raw", weights(F.col("n"), F.col("df"), n_chunks))
    size = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("chunk_id")))
    return raw.select("chunk_id", "term", "column", (F.col("raw") / size).alias("weight"))


def _blocks(matrix: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for first in range(0, len(matrix), BLOCK):
        yield first // BLOCK, np.ascontiguousarray(matrix[first : first + BLOCK], np.float64).tobytes()


def _stacked(table: pa.Table, width: int) -> np.ndarray:
    """A matrix from its row blocks."""
    rows = sorted(zip(table["block"].to_pylist(), table["data"].to_pylist()))
    return np.concatenate([np.frombuffer(data, np.float64).reshape(-1, width) for _, data in rows])


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([b for b, _ in rows], pa.int64()), "data": pa.array([d for _, d in rows], pa.binary())})


def _packed(matrix: DataFrame) -> DataFrame:
    """(part, ends, columns, weights): the rows (part, columns, weights) of a part as one row of plain numbers."""
    def pack(rows: pa.Table) -> pa.Table:
        columns, values = rows["columns"].combine_chunks(), rows["weights"].combine_chunks()
        ends = np.append(0, np.cumsum(columns.value_lengths().to_numpy())).astype(np.int64)
        numbers = (ends, columns.flatten().to_numpy().astype(np.int32), values.flatten().to_numpy().astype(np.float64))
        return pa.table({
            "part": rows["part"].slice(0, 1),
            **{name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("ends", "columns", "weights"), numbers)},
        })

    return matrix.groupBy("part").applyInArrow(pack, "part int, ends binary, columns binary, weights binary")


def _times(part: pa.Table, block: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A part's chunks times the word block, and the part's rows."""
    rows = []
    for packed in part.to_pylist():
        ends = np.frombuffer(packed["ends"], np.int64).tolist()
        columns, values = np.frombuffer(packed["columns"], np.int32), np.frombuffer(packed["weights"], np.float64)
        rows += [(columns[i:j], values[i:j]) for i, j in zip(ends, ends[1:])]
    return np.stack([w @ block[c] for c, w in rows]), rows


def _back_and_forth(matrix: DataFrame, block: DataFrame, parts: int, width: int) -> DataFrame:
    """Row blocks of the transposed matrix times the matrix times ``block``.

    Each part meets a copy of the word block in one task; partial sums are added in two steps, so
    no task gets more than about the square root of the parts.
    """
    copies = block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def both(part: pa.Table, word: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _table([])
        dense = _stacked(word, width)
        there, rows = _times(part, dense)
        out = np.zeros_like(dense)
        for (columns, values), row in zip(rows, there):
            out[columns] += values[:, None] * row
        return _table(list(_blocks(out)))

    met = matrix.groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(both, _PIECES)

    def added(piece: pa.Table) -> pa.Table:
        data = sum(np.frombuffer(d, np.float64) for d in piece["data"].to_pylist())
        return _table([(piece["block"][0].as_py(), data.tobytes())])

    steps = max(1, math.isqrt(parts))
    if steps > 1:
        met = met.withColumn("step", F.pmod(F.xxhash64("data"), F.lit(steps))).groupBy("block", "step").applyInArrow(added, _PIECES)
    return met.groupBy("block").applyInArrow(added, _PIECES)


def _gram(matrix: DataFrame, block: DataFrame, parts: int, width: int) -> np.ndarray:
    """(matrix times block) transposed times itself: ``width`` by ``width``, added up from the parts."""
    copies = block.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def square(part: pa.Table, word: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _table([])
        there, _ = _times(part, _stacked(word, width))
        return _table([(0, (there.T @ there).tobytes())])

    met = matrix.groupBy("part").cogroup(copies.groupBy("part")).applyInArrow(square, _PIECES)
    return _sum_of_squares(met, width)


def _sum_of_squares(pieces: DataFrame, width: int) -> np.ndarray:
    """Sum of small square matrices, each task's added first."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width)
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(data.as_py(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    # All tasks at once; one more adds up their matrices.
    sums = pieces.select("data").mapInArrow(added, "data binary").repartition(1).mapInArrow(added, "data binary")
    return np.frombuffer(sums.first()["data"], np.float64).reshape(width, width)


def _orthonormal(block: DataFrame, width: int) -> DataFrame:
    """The block with orthonormal columns: each row block's R is gathered, their common R divides all.

    R comes from the Gram matrix of the row blocks' R, twice, which is as good as a QR of the whole.
    """
    for _ in range(2):
        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0):
                    r = np.linalg.qr(np.frombuffer(data.as_py(), np.float64).reshape(-1, width), mode="r")
                    yield pa.RecordBatch.from_arrays([pa.array([(r.T @ r).tobytes()], pa.binary())], ["data"])

        square = _sum_of_squares(block.select("data").mapInArrow(local, "data binary"), width)
        values, vectors = np.linalg.eigh(square)
        # Directions that the matrix does not have stay zero.
        scale = np.where(values > values.max() * 1e-13, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        block = spill(_turned(block, vectors * scale, width), "orthonormal")
    return block


def _turned(block: DataFrame, by: np.ndarray, width: int) -> DataFrame:
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(np.frombuffer(d.as_py(), np.float64).reshape(-1, width) @ by).tobytes() for d in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["block", "data"])

    return block.mapInArrow(turn, _PIECES)


@dataclass(frozen=True)
class Semantics:
    """Word vectors: ``words`` has (term, df, column, vector); ``values`` the singular values."""

    words: DataFrame
    values: list[float]
    n_chunks: int

    def of_counted(self, terms: DataFrame, key: str = "chunk_id") -> DataFrame:
        """(``key``, ``vector``) from counted words ``terms`` (key, terms): the chunk's tf-idf row in the found space, length one.

        Rows without a known word have a zero vector.
        """
        k = len(self.values)
        entries = terms.select(F.col(key).alias("key"), F.explode_outer("terms").alias("t")).select(
            "key", F.col("t.term").alias("term"), F.col("t.n").alias("n")
        )
        known = entries.join(broadcast_within(self.words, VOCABULARY), "term", "left")
        raw = F.coalesce(weights(F.col("n"), F.col("df"), self.n_chunks), F.lit(0.0))
        sums = [F.coalesce(F.sum(raw * F.get("vector", F.lit(i)).cast("double")), F.lit(0.0)).alias(f"v{i}") for i in range(k)]
        added = known.groupBy("key").agg(*sums).select("key", F.array(*[f"v{i}" for i in range(k)]).alias("sums"))
        sized = added.withColumn("size", F.sqrt(F.aggregate("sums", F.lit(0.0), lambda s, x: s + x * x)))
        unit = F.transform("sums", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(0.0).cast("float"))
        return sized.select(F.col("key").alias(key), unit.alias("vector"))

    def of_texts(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(``key``, ``vector``) of texts; null and empty texts have a zero vector."""
        found = search_tokens(F.coalesce(F.col(text), F.lit("")))
        rows = texts.select(F.col(key).alias("key"), F.explode_outer(found).alias("term"))
        counted = rows.groupBy("key", "term").agg(F.count("*").alias("n"))
        grouped = counted.groupBy("key").agg(
            F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "n"))).alias("terms")
        )
        return self.of_counted(grouped.withColumnRenamed("key", key), key)


def fit(
    terms: DataFrame, term_stats: DataFrame, n_chunks: int, dimensions: int = DIMENSIONS, extra: int = EXTRA,
    rounds: int = ROUNDS, size: int = VOCABULARY, seed: int = SEED, part: int = PART,
) -> Semantics | None:
    """Fits word vectors on all chunks; None where no word stands in two chunks.

    ``terms`` and ``term_stats`` are the index tables of that name. Words beyond ``size`` have no vector.
    The start is seeded per row block, so equal input gives equal vectors up to rounding.
    """
    spark = terms.sparkSession
    ship_package(spark)
    words = spill(vocabulary(term_stats, n_chunks, size), "vocabulary")
    known = words.count()
    if not known:
        return None
    parts = max(1, -(-n_chunks // part))
    # A round meets every part once, so a part is packed once instead of being turned into lists each time.
    matrix = spill(
        _packed(
            tfidf(terms, words, n_chunks, size).groupBy("chunk_id")
            .agg(F.collect_list("column").alias("columns"), F.collect_list("weight").alias("weights"))
            .select(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), "columns", "weights")
        ),
        "tfidf",
    )
    width = min(dimensions + extra, known)
    block = spill(_random(spark, known, width, seed), "start")
    for _ in range(rounds):
        block = _orthonormal(spill(_back_and_forth(matrix, block, parts, width), "power"), width)
    values, vectors = np.linalg.eigh(_gram(matrix, block, parts, width))
    keep = min(dimensions, width)
    order = np.argsort(-values)[:keep]
    rows = _turned(block, vectors[:, order], width)

    def spread_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(data, np.float64).reshape(-1, keep).astype(np.float32)
                ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * keep)
                columns = pa.array(number * BLOCK + np.arange(len(values)))
                lists = pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([columns, lists], ["column", "vector"])

    found = rows.mapInArrow(spread_rows, "column long, vector array<float>")
    named = spill(words.join(found, "column").select("term", "df", "column", "vector"), "semantics")
    return Semantics(named, [math.sqrt(max(v, 0.0)) for v in values[order].tolist()], n_chunks)


def _random(spark: SparkSession, rows: int, width: int, seed: int) -> DataFrame:
    """Row blocks of normal random numbers, each drawn in its task."""
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for number in frame["id"]:
                n = min(BLOCK, rows - number * BLOCK)
                out.append((number, np.random.default_rng([seed, number]).normal(size=(n, width)).tobytes()))
            yield pd.DataFrame(out, columns=["block", "data"])

    return spark.range(-(-rows // BLOCK)).mapInPandas(draw, _PIECES)
