"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import ship_package, spill

# A span is the shortest run of at least so many sentences that has at least so many words.
SENTENCES = 2
WORDS = 20
# A longer sentence counts as several of at most this many words, cut where its last words say so.
SENTENCE_WORDS = 20
# A long sentence is cut behind so many words if their hash is a multiple of the second number.
CUT_WORDS, CUT_RATE = 3, 4

# Sentences end at . ! ? before white space, at an ideographic full stop or wide ! ?, and at line breaks.
_END = re.compile(
    rb"[.!?]+[\x20\x09-\x0d]+|(?:\xe3\x80\x82|\xef\xbc[\x81\x9f])+[\x20\x09-\x0d]*|[\x0a\x0d][\x20\x09-\x0d]*"
)
# Signs of scripts without spaces (Han, kana, Thai, Lao, Burmese, Khmer) are words of their own.
_SIGN = (
    rb"(?:\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xf0[\xa0-\xb3][\x80-\xbf]{2}"
    rb"|\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf])"
)
_SPACELESS = re.compile(_SIGN)
_WORD = re.compile(rb"(?:" + _SIGN + rb"|(?:(?!" + _SIGN + rb")[^\x20\x09-\x0d])+)[\x20\x09-\x0d]*")


def _cuts(words: list[bytes]) -> list[int]:
    """Starts of the parts of a long sentence, the same in a passage whatever stands before it."""
    cuts = [0]
    for end in range(1, len(words)):
        last = words[max(0, end - CUT_WORDS) : end]
        if end - cuts[-1] == SENTENCE_WORDS or (
            len(last) == CUT_WORDS and xxhash.xxh64_intdigest(b" ".join(last)) % CUT_RATE == 0
        ):
            cuts.append(end)
    return cuts


def sentences(data: bytes) -> tuple[list[int], list[int], list[bytes]]:
    """(start, words, content) of the sentences of a UTF-8 text; each ends where the next starts.

    Content is the words in ASCII lower case with single spaces. White space goes with what stands before it.
    """
    starts, counts, contents = [], [], []
    at = 0
    spaceless = _SPACELESS.search(data) is not None
    ends = [m.end() for m in _END.finditer(data)]
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    for end in ends:
        low = data[at:end].lower()
        words = [w.rstrip() for w in _WORD.findall(low)] if spaceless else low.split()
        if len(words) > SENTENCE_WORDS:
            places = [at + m.start() for m in _WORD.finditer(data[at:end])]
            cuts = _cuts(words)
            for i, stop in zip(cuts, [*cuts[1:], len(words)]):
                part = words[i:stop]
                starts.append(places[i])
                counts.append(len(part))
                contents.append(b" ".join(part))
        elif words:
            starts.append(at)
            counts.append(len(words))
            contents.append(b" ".join(words))
        at = end
    return starts, counts, contents


def spans(counts: list[int], contents: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, end, digest) of the span that starts at each sentence, where the text is long enough."""
    stop, words = 0, 0
    for start in range(len(counts)):
        while stop < len(counts) and (stop - start < SENTENCES or words < WORDS):
            words += counts[stop]
            stop += 1
        if stop - start < SENTENCES or words < WORDS:
            return
        yield start, stop, xxhash.xxh128_digest(b" ".join(contents[start:stop]))
        words -= counts[start]


def ending_spans(counts: list[int], contents: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """As :func:`spans`, and also the shortest span that ends at each sentence; each span once.

    Together they cover every sentence that any run of the least size within a passage covers.
    """
    taken = set()
    for first, stop, digest in spans(counts, contents):
        taken.add((first, stop))
        yield first, stop, digest
    first, words = 0, 0
    for stop in range(1, len(counts) + 1):
        words += counts[stop - 1]
        while stop - first > SENTENCES and words - counts[first] >= WORDS:
            words -= counts[first]
            first += 1
        if stop - first >= SENTENCES and words >= WORDS and (first, stop) not in taken:
            yield first, stop, xxhash.xxh128_digest(b" ".join(contents[first:stop]))


def _spans_of_rows(batches: Iterator[pa.RecordBatch], of=spans) -> Iterator[pa.RecordBatch]:
    """Rows (id, text hash, text) to rows (id, text hash, first, end, h1, h2)."""
    names = ["id", "code", "first", "stop", "h1", "h2"]

    def batch_of(batch, rows, firsts, stops, digests):
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(rows, pa.int64())
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(firsts, pa.int32()), pa.array(stops, pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names)

    for batch in batches:
        rows, firsts, stops, digests = [], [], [], []
        for n, text in enumerate(batch.column(2)):
            _, counts, contents = sentences(text.as_py() or b"")
            for first, stop, digest in of(counts, contents):
                rows.append(n)
                firsts.append(first)
                stops.append(stop)
                digests.append(digest)
            if len(rows) > 1 << 18:
                yield batch_of(batch, rows, firsts, stops, digests)
                rows, firsts, stops, digests = [], [], [], []
        if rows:
            yield batch_of(batch, rows, firsts, stops, digests)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: bool = False) -> DataFrame:
    """(id, ``code``, ``first``, ``stop``, ``source_id``) of every span that stands elsewhere before.

    ``code`` is the hash of the text, ``source_id`` the document of the first place. Places are ordered by
    id (null last), text hash and sentence, over the whole table. They are shuffled once, as numbers, and neither
    written nor joined: a window over the places of a span has the first one. The places of one span meet in one task,
    which sorts them outside its memory.
    With ``ends`` the shortest spans that end at each sentence count too.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("code"), F.col(text_col).cast("binary").alias("text")
    )
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, code long, first int, stop int, h1 long, h2 long"
    places = texts.mapInArrow(partial(_spans_of_rows, of=ending_spans if ends else spans), schema)
    order = W.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last(), "code", "first")
    later = places.withColumn("head", F.first(F.struct("id", "code", "first")).over(order)).where(
        ~(F.col("id").eqNullSafe(F.col("head.id")) & (F.col("code") == F.col("head.code")) & (F.col("first") == F.col("head.first")))
    )
    return later.select("id", "code", "first", "stop", F.col("head.id").alias("source_id"))


def merged(firsts, stops) -> list[tuple[int, int]]:
    """Sorted ranges of sentences that the spans cover; touching spans are one range."""
    out: list[list[int]] = []
    for first, stop in sorted(zip(firsts, stops)):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [tuple(r) for r in out]


def _without(data: bytes, firsts, stops) -> tuple[bytes, int]:
    """The text without the covered sentences, and the number of words removed."""
    starts, counts, _ = sentences(data)
    edges = [*starts, len(data)]
    kept, at, words = [], 0, 0
    for first, stop in merged(firsts, stops):
        kept.append(data[at : edges[first]])
        at = edges[stop]
        words += sum(counts[first:stop])
    return b"".join([*kept, data[at:]]), words


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: bool = False) -> DataFrame:
    """``docs`` with the sentences removed that a span standing elsewhere before covers.

    All columns stay, ``text_col`` holds the rest of the text; three columns follow:
    ``removed_sentences``, ``removed_words`` and ``source_ids`` (sorted ids of documents where a removed
    span stands first). Columns of these names in ``docs`` are replaced. Null texts stay null, empty
    texts and texts without a span stay as they are. Rows with equal id and text are one document to the
    spans and get the same result; equal texts under several ids keep one of them, the
    smallest id (null last). An empty table gives an empty result. Without ``ends`` only the shortest span
    from each sentence is looked at, which leaves short last sentences of a passage.
    """
    found = repeated_spans(docs, id_col, text_col, ends)
    spots = spill(
        found.groupBy("id", "code").agg(
            F.collect_set(F.struct("first", "stop")).alias("__spots"), F.collect_set("source_id").alias("__sources")
        ).withColumnsRenamed({"id": "__id", "code": "__code"}),
        "spots",
    )

    @F.pandas_udf("text binary, words long, sentences long")
    def rest(texts: pd.Series, spots: pd.Series) -> pd.DataFrame:
        out = []
        for text, spot in zip(texts, spots):
            firsts, stops = [s["first"] for s in spot], [s["stop"] for s in spot]
            out.append((*_without(text, firsts, stops), sum(b - a for a, b in merged(firsts, stops))))
        return pd.DataFrame(out, columns=["text", "words", "sentences"])

    own = docs.withColumn("__own", F.xxhash64(docs[text_col]))
    joined = own.join(spots, own[id_col].eqNullSafe(spots["__id"]) & (own["__own"] == spots["__code"]), "left")
    # Only texts with spans go through Python, once: a filter on the result must not call it again.
    hit, plain = joined.where("__spots IS NOT NULL"), joined.where("__spots IS NULL")
    marked = hit.withColumn("__rest", rest.asNondeterministic()(F.col(text_col).cast("binary"), F.col("__spots")))
    new = {"removed_sentences", "removed_words", "source_ids"}

    def result(rows: DataFrame, text: Column, n_sentences: Column, n_words: Column, sources: Column) -> DataFrame:
        columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in new]
        return rows.select(
            *columns, n_sentences.alias("removed_sentences"), n_words.alias("removed_words"), sources.alias("source_ids")
        )

    none, zero = F.array().cast(spots.schema["__sources"].dataType), F.lit(0).cast("long")
    return result(
        marked, F.col("__rest.text").cast("string"), F.col("__rest.sentences"), F.col("__rest.words"), F.array_sort("__sources")
    ).union(result(plain, F.col(text_col), zero, zero, none))
