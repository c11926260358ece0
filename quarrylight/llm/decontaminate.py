"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import ship_package
from .words import overlapped, plain_words

SHINGLE = 5
CONTAINMENT = 0.8
# Chance that the sketches of an item and a text that holds it share no value.
MISS = 1e-6
# Items of fewer shingles are looked up by all shingles of a text.
SHORT = 16
# Bytes of item texts that are broadcast together.
ITEM_BYTES = 8 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _STEP + single[i : i + n]
    for shift, factor in zip((30, 27), _MIX):
        out = (out ^ (out >> np.uint64(shift))) * factor
    return out ^ (out >> np.uint64(31))


def _shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    if len(words) < size:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*(words[i:] for i in range(size))))


def text_hashes(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; none for a text without words."""
    parts = [shingle_hashes(words, size) for words in overlapped(plain_words(data), size)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def bins_for(items: int, texts: int, containment: float, miss: float = MISS) -> int:
    """MinHash bins by which items of at least ``items`` shingles are found in texts of at most ``texts``.

    A shared shingle counts in its bin only if no other shingle of item and text is lower there; the item is
    missed if each of its shared shingles loses its bin. The bins are raised until that chance is within ``miss``.
    """
    shared = max(1, math.ceil(containment * items - 1e-9))
    union = texts + items - shared
    if union <= shared:
        return 1
    bins = 1
    while True:
        wins = bins / union * -math.expm1(union * math.log1p(-1 / bins)) if bins > 1 else 1 / union
        if wins >= 1 or shared * math.log1p(-wins) <= math.log(miss):
            return bins
        bins += max(1, bins >> 4)


def sketch(hashes: np.ndarray, bins: int | None) -> np.ndarray:
    """The least hash in each of ``bins`` equal ranges: a MinHash signature of one permutation; all hashes without ``bins``."""
    if bins is None:
        return hashes
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    return hashes[np.concatenate([[True], at[1:] != at[:-1]])] if len(hashes) else hashes


class ItemBlock:
    """Items of one broadcast: their shingles, dealt to classes by their number."""

    def __init__(self, items: list[tuple[object, bytes]], size: int, containment: float):
        self.size, self.containment = size, containment
        self.ids, self.shingles, classes = [], [], {}
        self.phrases: dict[int, dict[bytes, list[int]]] = {}
        for key, data in items:
            words = [w for block in plain_words(data) for w in block]
            if words:
                found = frozenset(_shingles(words, size))
                if len(words) < size:
                    self.phrases.setdefault(len(words), {}).setdefault(*found, []).append(len(self.ids))
                else:
                    classes.setdefault(len(found).bit_length(), []).append(len(self.ids))
                self.ids.append(key)
                self.shingles.append(found)
        hashes = lambda i: np.unique(np.concatenate([shingle_hashes(s.split(b" "), size) for s in self.shingles[i]]))
        self.classes = [(min(len(self.shingles[i]) for i in of), of, [hashes(i) for i in of]) for of in classes.values()]
        self.tables: dict[int, list] = {}

    def _tables(self, partition: int) -> list:
        """For texts of at most ``2 ** partition`` shingles: bins, sketch values, and the items of each value."""
        if partition not in self.tables:
            out = []
            for least, of, hashes in self.classes:
                bins = None if least < SHORT else bins_for(least, 1 << partition, self.containment)
                held = [sketch(h, bins) for h in hashes]
                owner = np.repeat(np.array(of), [len(h) for h in held])
                values = np.concatenate(held)
                order = np.argsort(values, kind="stable")
                single, first = np.unique(values[order], return_index=True)
                out.append((bins, single, np.append(first, len(values)), owner[order]))
            self.tables[partition] = out
        return self.tables[partition]

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Items that share a sketch value with a text."""
        found: set[int] = set()
        for bins, values, first, owner in self._tables(max(0, len(hashes) - 1).bit_length()):
            mine = sketch(hashes, bins)
            at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
            for i in np.unique(at[values[at] == mine]):
                found.update(owner[first[i] : first[i + 1]].tolist())
        return found

    def matches(self, data: bytes | None) -> list[tuple[int, int]]:
        """(item number, shared shingles) of the items that a text contains, by exact comparison."""
        short = {i for width, of in self.phrases.items() for i in self._held_phrases(data, width, of)}
        hashes = text_hashes(data, self.size) if self.classes else ()
        near = self.candidates(hashes) if len(hashes) else set()
        if not near:
            return [(i, 1) for i in sorted(short)]
        wanted = frozenset().union(*(self.shingles[i] for i in near))
        held: set[bytes] = set()
        for words in overlapped(plain_words(data), self.size):
            held.update(s for s in _shingles(words, self.size) if s in wanted)
        shared = [(i, len(self.shingles[i] & held)) for i in sorted(near)]
        return sorted([(i, n) for i, n in shared if n / len(self.shingles[i]) >= self.containment] + [(i, 1) for i in short])

    @staticmethod
    def _held_phrases(data: bytes | None, width: int, of: dict[bytes, list[int]]) -> Iterator[int]:
        """Items of ``width`` words that stand in a text as a whole."""
        for words in overlapped(plain_words(data), width):
            for phrase in of.keys() & set(_shingles(words, width)):
                yield from of[phrase]


def _item_blocks(items: DataFrame, id_col: str, text_col: str, size: int, containment: float) -> Iterator[ItemBlock]:
    """The items in blocks of a bounded number of bytes."""
    kind = "long" if isinstance(items.schema[id_col].dataType, IntegralType) else "string"
    block, held = [], 0
    rows = items.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("binary").alias("text"))
    for row in rows.toLocalIterator():
        data = bytes(row["text"] or b"")
        if block and held + len(data) > ITEM_BYTES:
            yield ItemBlock(block, size, containment)
            block, held = [], 0
        block.append((row["id"], data))
        held += len(data)
    yield ItemBlock(block, size, containment)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SHINGLE,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(id, ``item_id``, ``shared``, ``item_shingles``, ``containment``) of every item that a document contains.

    An item counts as contained if at least ``containment`` of its distinct shingles
    (``size`` words; an item of fewer words is one shingle of its own length) stand in the document. Documents
    fall into partitions by their number of shingles, each with as many MinHash bins as its
    largest size needs; items of fewer than ``SHORT`` shingles are looked up by all shingles of the
    text, so they are found in texts of any length. Pairs that share a value are then compared shingle by shingle. Items go to the tasks in broadcast
    blocks of ``ITEM_BYTES``, one pass over the documents per block; documents are not
    shuffled. Texts and items that are null or have no words match nothing. Repeated rows
    and ties give a row each. Columns beside the named ones are ignored. Either table may
    be empty.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kind = "bigint" if isinstance(items.schema[item_id_col].dataType, IntegralType) else "string"
    item_type = pa.int64() if kind == "bigint" else pa.string()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, item_id {kind}, shared bigint, item_shingles bigint, containment double"

    def search(block):
        def run(batches):
            items = block.value
            for batch in batches:
                rows, hits = [], []
                for n, data in enumerate(batch.column(1)):
                    found = items.matches(data.as_py())
                    rows += [n] * len(found)
                    hits += found
                if hits:
                    sizes = [len(items.shingles[i]) for i, _ in hits]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows)),
                            pa.array([items.ids[i] for i, _ in hits], item_type),
                            pa.array([n for _, n in hits], pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array([n / s for (_, n), s in zip(hits, sizes)], pa.float64()),
                        ],
                        ["id", "item_id", "shared", "item_shingles", "containment"],
                    )

        return run

    out = None
    for block in _item_blocks(items, item_id_col, item_text_col, size, containment):
        part = texts.mapInArrow(search(spark.sparkContext.broadcast(block)), schema)
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SHINGLE,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """The rows of ``docs`` that contain no item; all columns are kept. Cases as in :func:`contained_items`."""
    spark = docs.sparkSession
    ship_package(spark)

    def clean(block):
        @F.pandas_udf("boolean")
        def of(texts: pd.Series) -> pd.Series:
            return pd.Series([not block.value.matches(t) for t in texts], dtype=bool)

        return of

    for block in _item_blocks(items, item_id_col, item_text_col, size, containment):
        docs = docs.where(clean(spark.sparkContext.broadcast(block))(docs[text_col].cast("binary")))
    return docs
