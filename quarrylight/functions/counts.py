"""Counted words and keywords of chunks, many chunks at a time.

The same rows as :func:`quarrylight.functions.text.with_term_counts` and ``with_keywords`` give, at a fraction of their
time. Only texts of scripts whose letters and lower case are the same in every Unicode version go this way; the others
are counted by the column functions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import fixed
from .text import with_keywords, with_term_counts

# Latin, Cyrillic, Greek without the capital sigma (its lower case depends on its place), punctuation, common ideographs.
SETTLED = r"^[\x{0}-\x{3A2}\x{3A4}-\x{52F}\x{2000}-\x{206F}\x{20AC}\x{4E00}-\x{9FA5}]*$"
_ANY, _ASCII, _KEYWORD = regex.compile(fixed.SEARCH_PATTERN), re.compile("[a-z0-9]+"), re.compile(fixed.WORD_PATTERN.replace("A-Z", ""))
_UPPER = re.compile(fixed.WORD_PATTERN)
# Texts of Latin letters and common signs, without the capital that gets two characters in lower case: there the letters,
# marks and digits are what the standard library takes for them.
_PLAIN = re.compile(r"[\x00-\u012f\u0131-\u024f\u2000-\u206f\u20ac]*").fullmatch
_LATIN = re.compile(r"[^\W_]+")
_ROWS = (
    "chunk_id string, doc_id string, kind string, section_path array<string>, has_text boolean,"
    " terms array<struct<term:string,n:int,first_pos:int>>, dl int, keywords array<string>"
)


def search_words(text: str) -> list[str]:
    """Search words of a text, lower-cased, in reading order."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    return _LATIN.findall(text.lower()) if _PLAIN(text) else [w.lower() for w in _ANY.findall(text)]


def _words(text: str) -> tuple[list[str], list[str]]:
    """Search words and words that may be keywords, lower-cased, in reading order."""
    if text.isascii() or _PLAIN(text):
        lower = text.lower()
        return (_ASCII if text.isascii() else _LATIN).findall(lower), _KEYWORD.findall(lower)
    return [w.lower() for w in _ANY.findall(text)], [w.lower() for w in _UPPER.findall(text)]


def _counted(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[pa.RecordBatch]:
    stop = frozenset(fixed.KEYWORD_STOP)
    for batch in batches:
        terms, counts, first, ends, lengths, names, name_ends = [], [], [], [0], [], [], [0]
        for text in batch.column(4).to_pylist():
            words, may = _words(text or "")
            held = Counter(words)
            order = sorted(held)
            place = dict(zip(reversed(words), range(len(words) - 1, -1, -1)))
            terms += order
            counts += [held[w] for w in order]
            first += [place[w] for w in order]
            ends.append(len(terms))
            lengths.append(len(words))
            found = Counter(may)
            for w in stop & found.keys():
                del found[w]
            names += sorted(found, key=found.get, reverse=True)[:kept]
            name_ends.append(len(names))
        entries = pa.StructArray.from_arrays(
            [pa.array(terms, pa.string()), pa.array(counts, pa.int32()), pa.array(first, pa.int32())], ["term", "n", "first_pos"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:4], batch.column(5), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
                pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(name_ends, pa.int32()), pa.array(names, pa.string())),
            ],
            names=["chunk_id", "doc_id", "kind", "section_path", "has_text", "terms", "dl", "keywords"],
        )


def counted_chunks(chunks: DataFrame, kept: int) -> DataFrame:
    """A row per chunk: its counted search words ``terms`` in order, its length ``dl`` and its first ``kept`` keywords. Map-only."""
    ship_package(chunks.sparkSession)
    rows = chunks.select("chunk_id", "doc_id", "kind", "section_path", "text")
    settled = F.coalesce(F.col("text").rlike(SETTLED), F.lit(True))
    fast = rows.filter(settled).select("*", (F.length("text") > 0).alias("has_text")).mapInArrow(lambda b: _counted(b, kept), _ROWS)
    slow = with_term_counts(with_keywords(rows.filter(~settled), "text", kept), "text", search=True).select(
        "chunk_id", "doc_id", "kind", "section_path", (F.length("text") > 0).alias("has_text"), "terms",
        F.aggregate("terms", F.lit(0), lambda s, t: s + t["n"]).alias("dl"), "keywords",
    )
    return fast.union(slow)
