"""Byte-level BPE encoding and decoding by batched merge rounds over flat arrays of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the word pattern that this kind of vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters and numbers that the tokenizers library's Unicode tables do not know; it takes them for signs.
UNKNOWN = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)

# Characters that are cut into words at a time, where the text has a place for it.
PIECE = 1 << 20
# Words of up to so many bytes are merged together, longer ones each alone.
SHORT = 256
# Symbols that are merged together.
FLAT = 1 << 18
# Words and ids of them that a worker remembers; beyond that it starts anew.
KNOWN_WORDS = 1 << 19
KNOWN_IDS = 1 << 22

_NONE = np.int64(1) << 40


def _letters(known: bool) -> regex.Pattern:
    if known:
        return regex.compile(PATTERN)
    letters, numbers = rf"[\p{{L}}--[{UNKNOWN}]]", rf"[\p{{N}}--[{UNKNOWN}]]"
    signs = rf"[[^\s\p{{L}}\p{{N}}]||[{UNKNOWN}]]"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?{signs}+|\s+(?!\S)|\s+")


_WORDS, _WORDS_UNKNOWN = _letters(True), _letters(False)
_MAY_BE_UNKNOWN, _UNKNOWN = re.compile("[\u0558-\U0010ffff]"), re.compile(f"[{UNKNOWN}]")
# The same pattern where all characters are ASCII.
_WORDS_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_PLACE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")


def words(text: str) -> list[str]:
    """The words of a text that has no special token in it; joined, they are the text."""
    if text.isascii():
        return _WORDS_ASCII.findall(text)
    unknown = _MAY_BE_UNKNOWN.search(text) and _UNKNOWN.search(text)
    return (_WORDS_UNKNOWN if unknown else _WORDS).findall(text)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A text cut before spaces between a letter or digit and a letter of ASCII, where a word always starts."""
    at = 0
    while len(text) - at > size:
        place = _PLACE.search(text, at + size)
        if not place:
            break
        yield text[at : place.start()]
        at = place.start()
    yield text[at:]


def byte_characters() -> dict[str, int]:
    """The characters by which vocabulary files write bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for b, c in [*zip(plain, plain), *zip(rest, range(256, 512))]}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, content: dict):
        model = content["model"]
        kind = content.get("pre_tokenizer") or {}
        plain = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        if model.get("type") != "BPE" or not plain or content.get("normalizer") or model.get("byte_fallback"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "fuse_unk")):
            raise ValueError("options of the BPE model that are not supported")
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", ())}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in content.get("added_tokens", ())):
            raise ValueError("special tokens that take white space with them are not supported")
        of_char, ids = byte_characters(), model["vocab"]
        byte_id = {b: ids[c] for c, b in of_char.items() if c in ids}
        if len(byte_id) < 256:
            raise ValueError("a vocabulary without all 256 bytes")
        self.byte_id = np.array([byte_id[b] for b in range(256)], np.int64)
        # A pair's key is left id, then right id; keys are sorted, so a pair is found by binary search.
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort((left << 32) | right)
        self.keys = ((left << 32) | right)[order]
        self.ranks = order.astype(np.int64)
        self.made = made
        # A symbol is made by one merge, which stands before all that use it; so a merge never makes a pair of lower rank.
        born = np.full(max(ids.values()) + 1, -1, np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or not ((born[left] < np.arange(len(made))) & (born[right] < np.arange(len(made)))).all():
            raise ValueError("merges that are not in the order of their making")
        texts = {i: bytes(of_char[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        sizes = np.zeros(max(texts) + 1, np.int64)
        for i, t in texts.items():
            sizes[i] = len(t)
        self.sizes = sizes
        self.starts = np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(texts.get(i, b"") for i in range(len(sizes))), np.uint8)
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._forget()

    def _forget(self) -> None:
        """Remembers the special tokens alone: the ids of known words lie in ``flat`` from ``first`` on."""
        self.known = {w: n for n, w in enumerate(self.special)}
        self.flat = np.array(list(self.special.values()), np.int64)
        self.first, self.count = np.arange(len(self.flat)), np.ones(len(self.flat), np.int64)
        self.used = len(self.flat)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, by binary search; a number beyond all ranks where they do not merge."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over the symbols of many words: in each, every word merges its pairs of lowest rank.

        Words without a pair left move out, so later rounds only see what is still merging.
        """
        done_symbols, done_words = [], []
        rank = np.full(len(symbols), _NONE)
        rank[:-1] = np.where(word[1:] == word[:-1], self.rank(symbols[:-1], symbols[1:]), _NONE)
        while len(symbols):
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, heads)
            lengths = np.diff(heads, append=len(symbols))
            if (least == _NONE).any():
                stay = np.repeat(least < _NONE, lengths)
                done_symbols.append(symbols[~stay])
                done_words.append(word[~stay])
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                lengths, least = lengths[least < _NONE], least[least < _NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            hit = hit[_leftmost(hit[1:] == hit[:-1] + 1)]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[hit] = True
            symbols, word, rank, changed = symbols[keep], word[keep], rank[keep], changed[keep]
            changed[:-1] |= changed[1:]  # a merged symbol has a new pair on either side
            again = np.flatnonzero(changed)
            rank[again] = _NONE
            inner = again[again + 1 < len(symbols)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.rank(symbols[inner], symbols[inner + 1])
        if not done_symbols:
            return symbols, word
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _long(self, data: bytes) -> np.ndarray:
        """Merge rounds over one long word: a round takes all places of the lowest rank and touches nothing else."""
        symbols = self.byte_id[np.frombuffer(data, np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, _NONE)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] < _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for group in np.split(at, cuts) if len(at) else ():
                r = int(rank[group[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(group)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = at[_leftmost(after[at[:-1]] == at[1:])]
            gone = after[at]
            symbols[at] = self.made[r]
            rank[gone] = _NONE
            alive[gone] = False
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            rank[at] = _NONE
            rank[inner] = self.rank(symbols[inner], symbols[after[inner]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self.rank(symbols[left], symbols[after[left]])
            wait(np.union1d(at, left))
        return symbols[alive]

    def _learn(self, new: list[str]) -> None:
        """Ids of words that were not known, kept as one flat array with their places."""
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        size = np.array([len(c) for c in coded], np.int64)
        counts, found = np.zeros(len(new), np.int64), {}
        short = np.flatnonzero(size <= SHORT)
        for at in np.flatnonzero(size > SHORT).tolist():
            found[at] = self._long(coded[at])
            counts[at] = len(found[at])
        parts: list[np.ndarray] = []
        groups = np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short]) // FLAT)) + 1) if len(short) else []
        for group in groups:
            flat = self.byte_id[np.frombuffer(b"".join([coded[i] for i in group.tolist()]), np.uint8)]
            ids, word = self._rounds(flat, np.repeat(np.arange(len(group)), size[group]))
            counts[group] = np.bincount(word, minlength=len(group))
            parts.append(ids)
        # Short words lie one after the other, long ones behind them.
        order = np.concatenate([short, np.array(list(found), np.int64)]).astype(np.int64)
        flat = np.concatenate([*parts, *found.values()]) if len(new) else np.zeros(0, np.int64)
        known = len(self.known) - len(new)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(2 * (self.used + len(flat)), np.int64)])
        if len(self.known) > len(self.first):
            self.first = np.concatenate([self.first[:known], np.zeros(2 * len(self.known), np.int64)])
            self.count = np.concatenate([self.count[:known], np.zeros(2 * len(self.known), np.int64)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.first[known + order] = self.used + np.cumsum(counts[order]) - counts[order]
        self.count[known : known + len(new)] = counts
        self.used += len(flat)

    def _cut(self, piece: str) -> list[str]:
        """Words and special tokens of a piece, in order."""
        if not self.split or not self.split.search(piece):
            return words(piece)
        found, at = [], 0
        for m in self.split.finditer(piece):
            found += [*words(piece[at : m.start()]), m.group()]
            at = m.end()
        return found + words(piece[at:])

    def _ids(self, found: list[list[str]]) -> list[np.ndarray]:
        """Ids of lists of words; those that are not known yet are merged together."""
        if len(self.known) > KNOWN_WORDS or self.used > KNOWN_IDS:
            self._forget()
        known = self.known
        new = [w for w in dict.fromkeys(chain.from_iterable(found)) if w not in known]
        if new:
            at = len(known)
            known.update(zip(new, range(at, at + len(new))))
            self._learn(new)
        out = []
        for piece in found:
            which = np.fromiter(map(known.__getitem__, piece), np.int64, len(piece))
            out.append(_gathered(self.flat, self.first[which], self.count[which]).astype(np.uint32))
        return out

    def encode_all(self, texts: Iterable[str], size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids) of all texts, piece by piece, in order.

        Special tokens that stand in a text have their own ids.
        """
        held, chars = [], 0
        for n, text in enumerate(texts):
            for piece in pieces(text, size):
                held.append((n, self._cut(piece)))
                chars += len(piece)
                if chars > 2 * size:
                    yield from zip([m for m, _ in held], self._ids([f for _, f in held]))
                    held, chars = [], 0
        yield from zip([m for m, _ in held], self._ids([f for _, f in held]))

    def encode(self, text: str, size: int = PIECE) -> np.ndarray:
        """Ids of one text."""
        return np.concatenate([ids for _, ids in self.encode_all([text], size)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, special tokens included; ids that the vocabulary lacks have none."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        return _gathered(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()


def _leftmost(touching: np.ndarray) -> np.ndarray:
    """Which of sorted places merge: of places that touch each other the first, third, fifth and so on."""
    n = len(touching) + 1
    start = np.ones(n, bool)
    start[1:] = ~touching
    run = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    return (np.arange(n) - run) % 2 == 0


def _gathered(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ranges of a flat array, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(first - ends + count, count)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(json.load(file))


def _shipped(spark, path: str) -> str:
    ship_package(spark)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def _text(data: bytes | None) -> str:
    return (data or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(``id_col``, ``ids``): the ids of every row's whole text, no special tokens added.

    The strings of special tokens that stand in a text get those tokens' ids. Null and empty texts have an empty list;
    bytes that are no UTF-8 count as U+FFFD. Each row is encoded by itself, so repeated rows and ids stay as
    they are. Columns beside the two are ignored. An empty table gives an empty result. A task holds some
    millions of characters, or one text and its ids, at a time, and the ids of some ``KNOWN_WORDS`` words.
    """
    name = _shipped(docs.sparkSession, path)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(name))
        for batch in batches:
            held, start, size = [], 0, 0
            for n, parts in groupby(vocab.encode_all(_text(t.as_py()) for t in batch.column(1)), lambda x: x[0]):
                held.append(np.concatenate([ids for _, ids in parts]).astype(np.int32))
                size += len(held[-1])
                if size > 1 << 20 or n + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(held)), lists], ["id", "ids"])
                    held, start, size = [], n + 1, 0

    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """(``id_col``, ``text``): the text of every row's ids, special tokens included.

    A null list gives a null text, an empty one an empty text; null ids and ids that the vocabulary lacks have no text,
    and bytes that are no UTF-8 become U+FFFD. Columns beside the two are ignored.
    """
    name = _shipped(tokens.sparkSession, path)
    rows = tokens.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(name))
        for batch in batches:
            out = []
            for ids in batch.column(1):
                known = None if not ids.is_valid else ids.values.drop_null().to_numpy(zero_copy_only=False)
                out.append(None if known is None else vocab.decode(known).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``): every whole text encoded as by :func:`encode`
    and decoded as by :func:`decode`, with digests of both sides.

    The ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8. Ids are made, decoded and hashed
    piece by piece in the task, so neither ids nor decoded texts leave it. Cases as in :func:`encode`.
    """
    name = _shipped(docs.sparkSession, path)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(name))
        for batch in batches:
            counts, coded, decoded = [], [], []
            for _, parts in groupby(vocab.encode_all(_text(t.as_py()) for t in batch.column(1)), lambda x: x[0]):
                count, of_ids, of_text, rest = 0, hashlib.sha256(), hashlib.sha256(), b""
                for _, ids in parts:
                    count += len(ids)
                    of_ids.update(ids.astype("<u4").tobytes())
                    whole, rest = _whole(rest + vocab.decode(ids))
                    of_text.update(whole.decode("utf-8", "replace").encode())
                of_text.update(rest.decode("utf-8", "replace").encode())
                counts.append(count)
                coded.append(of_ids.hexdigest())
                decoded.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _whole(data: bytes) -> tuple[bytes, bytes]:
    """Bytes up to the last character that is complete, and the rest."""
    for back in range(1, min(4, len(data)) + 1):
        lead = data[-back]
        if lead & 0xC0 != 0x80:
            need = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
            return (data, b"") if need <= back else (data[:-back], data[-back:])
    return data, b""
