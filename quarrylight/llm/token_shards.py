"""Token ids in training order: a keyed permutation of sequences, written as fixed-stride shards."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, spill

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the word pattern that this vocabulary was made with.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# The vocabulary's free id, written after every document and as padding.
END = 50256
LENGTH = 1024
SEQUENCES_PER_SHARD = 4096
SEED = 29
ROUNDS = 6
WIDTH = 2  # bytes of an id
# The text sink ends each row with a line break, so a sequence's stride is one byte more than its ids.
TERMINATOR = "\n"
# Characters that are given to the tokenizer at a time, cut before a space.
PIECE = 1 << 18
# Bytes of text whose distinct words are encoded together.
BLOCK = 1 << 22


# The permutation


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _round_keys(seed: int) -> np.ndarray:
    step = np.uint64(0x9E3779B97F4A7C15)
    return _mixed((np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(ROUNDS)) * step)


def _walk(values: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(seed)
    out = np.asarray(values).astype(np.uint64)
    todo = np.arange(len(out))
    while todo.size:
        left, right = out[todo] >> half, out[todo] & low
        for key in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mixed(left ^ key) & low), left
            else:
                left, right = right, left ^ (_mixed(right ^ key) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def slots(index: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Slots of sequence numbers: a bijection of 0..n-1 by a keyed Feistel network.

    The network permutes the next even number of bits; a value beyond n - 1 is permuted
    again until it falls below n (fewer than four times on average).
    """
    return _walk(index, n, seed, False)


def sequences_at(slot: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Inverse of :func:`slots`."""
    return _walk(slot, n, seed, True)


# Tokens


@lru_cache(maxsize=2)
def _encoding(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if END in ranks.values() or max(ranks.values()) >= 1 << 8 * WIDTH:
        raise ValueError(f"{name}: ids must fit {WIDTH} bytes and leave {END} free for the end of a document")
    return Vocabulary(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks)


def pieces(text: str) -> Iterator[str]:
    """A text cut before spaces that follow a letter or digit, where the word pattern always cuts."""
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


class Vocabulary:
    """Ids of many texts at a time: every distinct word of a block is encoded once."""

    def __init__(self, encoding: tiktoken.Encoding, ranks: dict[bytes, int]):
        self.encoding = encoding
        self.bytes_of = np.zeros(1 << 8 * WIDTH, np.int64)
        self.bytes_of[list(ranks.values())] = [len(k) for k in ranks]

    def _one(self, word: bytes) -> np.ndarray:
        found = [self.encoding.encode_to_numpy(p, disallowed_special=()) for p in pieces(word.decode())]
        return np.concatenate(found).astype(np.uint16) if found else np.zeros(0, np.uint16)

    def _encoded(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after the other, and how many each has.

        Words that start with a space and stand between cuts are encoded as one text, where the pattern cuts them again.
        """
        data, ends = _bytes_of(words)
        sizes = np.diff(ends)
        plain = sizes > 1
        first, last = ends[:-1][plain], ends[1:][plain]
        plain[plain] = (data[first] == 32) & _before(data, last) & _after(data, first + 1)
        counts, found = np.zeros(len(words), np.int64), []
        for at in np.flatnonzero(~plain).tolist():
            found.append((np.array([at]), self._one(data[ends[at] : ends[at + 1]].tobytes())))
            counts[at] = len(found[-1][1])
        rest = np.flatnonzero(plain)
        groups = np.cumsum(sizes[rest]) // PIECE
        for some in np.split(rest, np.flatnonzero(np.diff(groups)) + 1):
            if len(some) == 1:
                ids = self._one(data[ends[some[0]] : ends[some[0] + 1]].tobytes())
                counts[some] = len(ids)
            elif len(some):
                joined, at = _bytes_of(words.take(pa.array(some)))
                text = joined[at[0] : at[-1]].tobytes().decode()
                ids = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
                stops = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[some])) + 1
                counts[some] = np.diff(np.append(0, stops))
            else:
                continue
            found.append((some, ids))
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint16)
        for some, ids in found:
            out[np.repeat(starts[some] - np.cumsum(counts[some]) + counts[some], counts[some]) + np.arange(len(ids))] = ids
        return out, counts

    def ids(self, texts: pa.Array, counts_alone: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """How many ids each text has with its end id, and all ids one after the other."""
        data, edges = _bytes_of(texts.cast(pa.binary()).fill_null(b""))
        space = np.flatnonzero(data[edges[0] : edges[-1]] == 32) + edges[0]
        space = space[(space > edges[0]) & (space < edges[-1] - 1)]
        space = space[_before(data, space) & _after(data, space + 1)]
        cut = np.zeros(edges[-1] + 1 - edges[0], bool)
        cut[space - edges[0]] = cut[edges - edges[0]] = True
        cuts = (np.flatnonzero(cut) + edges[0]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(
            pa.binary(), max(0, len(cuts) - 1), [None, pa.py_buffer(cuts), pa.py_buffer(data)]
        ).dictionary_encode()
        ids, counts = self._encoded(words.dictionary)
        at = words.indices.to_numpy()
        stops = np.searchsorted(cuts, edges)
        each = np.append(0, np.cumsum(counts[at]))[stops]
        sizes = np.diff(each) + 1
        if counts_alone:
            return sizes, None
        # The end id is a word of its own behind each text.
        at = np.insert(at, stops[1:], len(counts))
        starts = np.append(np.cumsum(counts) - counts, len(ids))
        counts = np.append(counts, 1)
        taken = counts[at]
        where = np.repeat((starts[at] - np.cumsum(taken) + taken).astype(np.int64), taken)
        where += np.arange(len(where))
        return sizes, np.append(ids, np.uint16(END))[where]


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes below a binary array and the places where its values start and end."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1] if offsets and len(values) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), ends


def _before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether what ends at a place is surely no white space; white space beyond ASCII starts with these bytes."""
    return (
        (data[at - 1] > 32) & (data[np.maximum(at - 2, 0)] != 0xC2) & ~np.isin(data[np.maximum(at - 3, 0)], (0xE1, 0xE2, 0xE3))
    )


def _after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether what starts at a place is surely no white space."""
    return (data[at] > 32) & ~np.isin(data[at], (0xC2, 0xE1, 0xE2, 0xE3))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about ``BLOCK`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        groups = (np.cumsum(sizes, dtype=np.int64) - sizes) // BLOCK
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for first, stop in zip(edges, edges[1:]):
            if stop > first:
                yield batch.slice(first, stop - first)


def _counted(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """(id, part, first token in the part, tokens) of every document of a partition."""
    part, at, vocabulary = TaskContext.get().partitionId(), 0, _encoding(name)
    for batch in _blocks(batches):
        sizes, _ = vocabulary.ids(batch.column(1), counts_alone=True)
        first = at + np.cumsum(sizes) - sizes
        at += int(sizes.sum())
        part_no = pa.array(np.full(len(sizes), part, np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), part_no, pa.array(first), pa.array(sizes)], ["id", "part", "first", "tokens"])


def _packed(batches: Iterator[pa.RecordBatch], name: str, length: int) -> Iterator[np.ndarray]:
    """Blocks of sequences of a partition: documents one after the other, the last sequence padded."""
    vocabulary, rest = _encoding(name), np.zeros(0, np.uint16)
    for batch in _blocks(batches):
        rest = np.append(rest, vocabulary.ids(batch.column(1))[1])
        for first in range(0, len(rest) // length * length, 256 * length):
            yield rest[first : min(first + 256 * length, len(rest) // length * length)].reshape(-1, length)
        rest = rest[len(rest) // length * length :].copy()
    if len(rest):
        yield np.append(rest, np.full(-len(rest) % length, END, np.uint16)).reshape(-1, length)


def _placed(batches, name: str, length: int, bases, total: int, seed: int) -> Iterator[pa.RecordBatch]:
    index = bases.value.get(TaskContext.get().partitionId(), 0)
    for block in _packed(batches, name, length):
        slot = slots(np.arange(index, index + len(block)), total, seed)
        index += len(block)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array([row.tobytes() for row in block.astype("<u2")], pa.binary())], ["slot", "data"]
        )


# Writing and reading


def _with_slots(batches: Iterator[pa.RecordBatch], total: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, sequence) with the slots of the sequences."""
    for batch in batches:
        slot = slots(batch.column(1).to_numpy(), total, seed)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot)], [*batch.schema.names, "slot"])


def write_shards(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    length: int = LENGTH,
    per_shard: int = SEQUENCES_PER_SHARD,
    seed: int = SEED,
    stored: bool = True,
) -> DataFrame:
    """Writes the sequences of ``docs`` in training order; returns (id, sequence) pairs.

    Documents of a partition are joined with an end id after each and cut into sequences of
    ``length`` ids; only a partition's last sequence is padded. A first pass counts tokens;
    the counts per partition (one number each, gathered by the driver) give every sequence
    its number, the permutation its slot. A second pass sends each sequence to the task of
    its range of slots, which writes ``path/shards/shard=<k>`` with ``per_shard`` sequences at a
    stride of ``WIDTH * length + 1`` bytes. Encoding twice moves no text and stages no tokens.
    Both passes see the same partitions if ``docs`` is a plain read of stored files; for any
    other plan pass ``stored=False``, and it is written to the shared folder first.

    Null and empty texts are an end id alone. Repeated rows are repeated; ties have no
    meaning here. Columns beside the two are ignored. An empty table writes no shard.
    ``path/meta`` holds total, length, per_shard and seed.
    """
    spark = docs.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts if stored else spill(texts, "texts")
    kind = texts.schema["id"].dataType.simpleString()
    counted = spill(
        texts.mapInArrow(lambda b: _counted(b, name), f"id {kind}, part int, first long, tokens long"), "counts"
    )
    bases, total = {}, 0
    for row in counted.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").toLocalIterator():
        bases[row["part"]] = total
        total += math.ceil(row["tokens"] / length)
    meta = [(total, length, per_shard, seed)]
    spark.createDataFrame(meta, "total long, length int, per_shard int, seed long").write.parquet(f"{path}/meta")
    if total:
        known = spark.sparkContext.broadcast(bases)
        placed = texts.mapInArrow(
            lambda b: _placed(b, name, length, known, total, seed), "slot long, data binary"
        ).withColumn("shard", F.floor(F.col("slot") / per_shard))
        shards = math.ceil(total / per_shard)
        tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        ranged = placed.repartitionById(tasks, F.floor(F.col("shard") * tasks / shards).cast("int"))
        ranged.sortWithinPartitions("shard", "slot").select("shard", F.col("data").cast("string").alias("value")).write.partitionBy(
            "shard"
        ).option("lineSep", TERMINATOR).text(f"{path}/shards")
    parts = spark.createDataFrame(list(bases.items()), "part int, base long")
    ends = counted.join(parts, "part").select(
        "id", (F.col("base") + F.floor(F.col("first") / length)).alias("low"),
        (F.col("base") + F.floor((F.col("first") + F.col("tokens") - 1) / length)).alias("high"),
    )
    pairs = ends.select("id", F.explode(F.sequence("low", "high")).alias("sequence"))
    # In Arrow like all other steps here: for a pandas function executors would keep workers of another kind besides.
    placed = pairs.mapInArrow(lambda b: _with_slots(b, total, seed), f"id {kind}, sequence long, slot long")
    return placed.withColumnRenamed("id", id_col)


def meta(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/meta").first()


def _shard_blocks(spark: SparkSession, path: str, from_slot: int, describe, schema: str) -> DataFrame:
    """Rows that ``describe`` makes of blocks (slots, shard, offsets, matrix of ids) of all shards from a slot on."""
    ship_package(spark)
    at = meta(spark, path)
    if not at["total"]:
        return spark.createDataFrame([], schema)
    stride = WIDTH * at["length"] + len(TERMINATOR)
    per_shard, length = at["per_shard"], at["length"]
    files = spark.read.format("binaryFile").load(f"{path}/shards")
    files = files.where(F.col("shard") >= from_slot // per_shard)

    def cut(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                for start in range(max(0, from_slot - shard * per_shard), len(rows), 1024):
                    block = rows[start : start + 1024]
                    order = np.arange(start, start + len(block))
                    ids = block[:, : WIDTH * length].copy().view("<u2")
                    yield describe(order + shard * per_shard, np.full(len(block), shard), order * stride, ids)

    return files.select(F.col("shard").cast("long").alias("shard"), "content").mapInArrow(cut, schema)


def read_shards(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """(slot, shard, offset, ids) from a slot on: whole shards before it are not opened."""

    def describe(slot, shard, offset, ids):
        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * ids.shape[1])
        lists = pa.ListArray.from_arrays(ends, pa.array(ids.reshape(-1).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(shard), pa.array(offset), lists], ["slot", "shard", "offset", "ids"])

    return _shard_blocks(spark, path, from_slot, describe, "slot long, shard long, offset long, ids array<int>")


def shard_digests(spark: SparkSession, path: str) -> DataFrame:
    """(slot, shard, offset, ``n_tokens``, ``digest``): ids that are not end ids, and a hash of all."""

    def describe(slot, shard, offset, ids):
        hashes = pa.array([xxhash.xxh64_hexdigest(row.tobytes()) for row in ids])
        counts = pa.array((ids != END).sum(axis=1).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(shard), pa.array(offset), counts, hashes], ["slot", "shard", "offset", "n_tokens", "digest"]
        )

    return _shard_blocks(spark, path, 0, describe, "slot long, shard long, offset long, n_tokens int, digest string")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per sequence as read back from its shard: ``slot``, ``shard``, ``offset``, ``n_tokens`` (end ids
    left out), ``digest`` and ``doc_ids`` (sorted distinct ids of the documents in it, null left out)."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-shards")
    pairs = write_shards(docs, path, id_col, text_col, **options)
    ids = pairs.groupBy("slot").agg(F.array_sort(F.collect_set(id_col)).alias("doc_ids"))
    return shard_digests(spark, path).join(ids, "slot")
