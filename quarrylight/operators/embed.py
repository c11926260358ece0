"""Text to vectors. The default embedder hashes words; models plug in by name."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.counts import search_words
from ..session import ship_package

DEFAULT_MODEL = "hashed-384"


class _Buckets(dict):
    """Twice the dimension of a word, from its MD5 digest, and one more where its sign is negative."""

    def __init__(self, dim: int, most: int = 200_000) -> None:
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, term: str) -> int:
        digest = hashlib.md5(term.encode("utf-8"), usedforsecurity=False).digest()
        if len(self) >= self.most:
            self.clear()
        self[term] = code = 2 * (int.from_bytes(digest[:4], "big") % self.dim) + (digest[4] >> 4 & 1)
        return code


class HashingEmbedder:
    """Signed feature hashing of log term frequencies, unit length, single precision."""

    def __init__(self, dim: int = 384) -> None:
        self.dim, self.buckets = dim, _Buckets(dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        words, counts, sizes = [], [], []
        for text in texts:
            held = Counter(search_words(text or ""))
            words += held
            counts += held.values()
            sizes.append(len(held))
        codes = np.fromiter(map(self.buckets.__getitem__, words), np.int64, len(words))
        weight = np.array([0.0] + [1.0 + math.log(n) for n in range(1, max(counts, default=0) + 1)])[np.array(counts, np.int64)]
        cells = np.repeat(np.arange(len(texts)), sizes) * self.dim + (codes >> 1)
        # Added up in the order of the words, as they come.
        out = np.bincount(cells, np.where(codes & 1, -weight, weight), len(texts) * self.dim).reshape(len(texts), self.dim)
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        size[size == 0] = 1.0
        return (out / size).astype(np.float32)


def _fastembed(model: str):
    from fastembed import TextEmbedding

    inner = TextEmbedding(model)

    class Adapter:
        def encode(self, texts: list[str]) -> np.ndarray:
            return np.asarray(list(inner.embed(list(texts))), dtype=np.float32)

    return Adapter()


_FACTORIES: dict[str, Callable[[], object]] = {DEFAULT_MODEL: HashingEmbedder}


def register_embedder(name: str, factory: Callable[[], object]) -> None:
    """Make ``factory`` available under ``name``; it must give an ``encode(texts)``."""
    _FACTORIES[name] = factory


@lru_cache(maxsize=4)
def get_embedder(name: str = DEFAULT_MODEL):
    """One embedder per worker process and model name."""
    return _FACTORIES[name]() if name in _FACTORIES else _fastembed(name)


def embed(
    df: DataFrame, text: str, model: str = DEFAULT_MODEL, out: str = "vector", unit: bool = False
) -> DataFrame:
    """Add the vector of ``text``. Map-only; the model is loaded once per worker.

    With ``unit`` vectors are scaled to length one; zero vectors stay.
    """
    ship_package(df.sparkSession)
    factory = _FACTORIES.get(model)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if factory is not None:
            register_embedder(model, factory)
        engine = get_embedder(model)
        for texts in batches:
            values = [t or "" for t in texts]
            vectors = np.asarray(engine.encode(values) if values else [], dtype=np.float32)
            if unit and len(values):
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                size[size == 0] = 1.0
                vectors = vectors / size
            yield pd.Series(list(vectors))

    return df.withColumn(out, encode(F.col(text)))
