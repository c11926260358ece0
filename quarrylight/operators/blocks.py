"""Block-max postings in shards of chunks: an exact top-k that opens only blocks which can reach a query's threshold.

A shard holds all postings of up to ``SHARD`` neighbouring chunks, a row per word. A word's postings are cut into blocks by ranges of
``RANGE`` chunks, each with the largest impact in it. So a task has all it needs for its chunks' full scores: nothing is
shuffled but each task's best chunks. Queries of few words are answered together, from lists by impact (:mod:`.lists`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, bounded_count, ship_package, spill
from .lists import FEW, Best, Lists, _runs
from .sparse import B, K1, inverse_frequency, top_by_query

SHARD = 1 << 16
RANGE = 64
# Ranges of a shard that are opened first, best bounds first; then twice as many at a time, as the threshold rises in between.
STEP = 2
# Up to ``FEW`` words with at most this many postings in a shard are added up whole, which costs less than choosing blocks.
WHOLE = 8192
# Scores are rounded to 1e-6; what cannot come within this of the threshold cannot tie with it either.
MARGIN = 1e-5
BLOCK_SCHEMA = (
    "shard long, term string, df int, ranges array<int>, tops array<double>, sizes array<int>,"
    " locals array<int>, tfs array<int>, dls array<int>, chunk_ids array<string>"
)


def _saturated(tf: np.ndarray, dl: np.ndarray, avg_len: float) -> np.ndarray:
    """The part of a BM25 score that a posting alone decides; below ``K1 + 1``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_len))


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _shard_rows(number: int, chunks: pa.Array, dl: np.ndarray, lists: pa.ListArray, avg_len: float) -> pa.RecordBatch:
    """A shard: one row with the chunks' ids, then a row per word."""
    local = np.repeat(np.arange(len(chunks), dtype=np.int64), np.diff(lists.offsets.to_numpy()))
    words, counts = lists.flatten().flatten()
    held = words.dictionary_encode()
    names = held.dictionary
    by_name = pc.sort_indices(names).to_numpy()
    place = np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    word = place[held.indices.to_numpy()] if len(held) else np.zeros(0, np.int64)
    order = np.lexsort((local, word))
    word, local, tf = word[order], local[order], counts.to_numpy(zero_copy_only=False)[order]
    length = dl[local]
    impact = _saturated(tf.astype(float), length, avg_len)
    n = len(names)
    ends = np.searchsorted(word, np.arange(n + 1))
    span = word * (SHARD // RANGE) + local // RANGE
    starts = np.flatnonzero(np.append(True, span[1:] != span[:-1])) if len(span) else np.zeros(0, np.int64)
    tops = np.maximum.reduceat(impact, starts) if len(starts) else np.zeros(0)
    block_ends = np.searchsorted(word[starts], np.arange(n + 1)) if len(starts) else np.zeros(n + 1, np.int64)
    lead = lambda x: np.append(0, x)  # noqa: E731  (the first row has no blocks)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number)), pa.concat_arrays([pa.array([None], pa.string()), names.take(pa.array(by_name)).cast(pa.string())]),
            pa.array(lead(np.diff(ends)), pa.int32()),
            _lists(local[starts] // RANGE, lead(block_ends), pa.int32()), _lists(tops, lead(block_ends), pa.float64()),
            _lists(np.diff(np.append(starts, len(local))), lead(block_ends), pa.int32()),
            _lists(local, lead(ends), pa.int32()), _lists(tf, lead(ends), pa.int32()), _lists(length, lead(ends), pa.int32()),
            pa.ListArray.from_arrays(pa.array([0] + [len(chunks)] * (n + 1), pa.int32()), chunks),
        ],
        names=["shard", "term", "df", "ranges", "tops", "sizes", "locals", "tfs", "dls", "chunk_ids"],
    )


def _sharded(batches: Iterator[pa.RecordBatch], avg_len: float, size: int) -> Iterator[pa.RecordBatch]:
    """Chunks (chunk_id, dl, terms) to shards of at most ``size`` chunks, in the order in which they come."""
    held, count, number = [], 0, TaskContext.get().partitionId() << 24

    def shard() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        chunks, dl, lists = [c.chunk(0) for c in table.columns]
        return _shard_rows(number, chunks, dl.to_numpy().astype(np.int64), lists, avg_len)

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == size:
                yield shard()
                held, count, number = [], 0, number + 1
    if count:
        yield shard()


def posting_shards(terms: DataFrame, avg_len: float, size: int = SHARD) -> DataFrame:
    """Shards of the counted words ``terms`` (chunk_id, dl, terms). Nothing is shuffled: neighbouring chunks share a shard.

    Written with one row group per file, a shard is always read by one task.
    """
    ship_package(terms.sparkSession)
    counted = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["n"].cast("int").alias("n")))
    rows = terms.select("chunk_id", F.col("dl").cast("int"), counted.alias("terms"))
    return rows.mapInArrow(lambda b: _sharded(b, avg_len, size), BLOCK_SCHEMA)


def postings_of(shards: DataFrame) -> DataFrame:
    """The postings of ``shards`` as rows (term, chunk_id, tf, dl)."""
    names = shards.filter(F.col("term").isNull()).select("shard", F.posexplode("chunk_ids").alias("local", "chunk_id"))
    entries = F.explode(F.arrays_zip(F.col("locals").alias("local"), F.col("tfs").alias("tf"), F.col("dls").alias("dl")))
    rows = shards.filter(F.col("term").isNotNull()).select("shard", "term", entries.alias("p")).select("shard", "term", "p.*")
    return rows.join(names, ["shard", "local"]).select("term", "chunk_id", "tf", "dl")


class _Asked:
    """Weighted query words for tasks, by query and by word. Queries of at most ``FEW`` words stand apart, a row each."""

    def __init__(self, rows):
        self.queries = sorted(set(rows["query_id"]))
        number = {q: i for i, q in enumerate(self.queries)}
        q = np.array([number[x] for x in rows["query_id"]], np.int64)
        few = np.bincount(q, minlength=len(self.queries)) <= FEW
        self.short = np.flatnonzero(few)
        self.words: dict[str, list[tuple[int, float]]] = {}
        idf = rows["idf"].to_numpy(np.float64)
        for query, term, weight in zip(q[~few[q]].tolist(), rows["term"][~few[q]], idf[~few[q]].tolist()):
            self.words.setdefault(term, []).append((query, weight))
        terms = sorted(set(rows["term"]))
        self.number = {t: i for i, t in enumerate(terms)}
        self.values = pa.array(terms, pa.string())
        # Rare words first.
        at = np.flatnonzero(few[q])
        at = at[np.lexsort((-idf[at], q[at]))]
        cell = np.searchsorted(self.short, q[at]), _runs(q[at])
        shape = len(self.short), 1 + int(cell[1].max(initial=0))
        self.places, self.weights = np.zeros(shape, np.int64), np.zeros(shape)
        names = rows["term"].to_numpy()
        self.places[cell] = [self.number[names[i]] for i in at]
        self.weights[cell] = idf[at]
        # Queries of the same words lie together, and so do the values looked up for them.
        order = np.lexsort(self.places.T)
        self.short, self.places, self.weights = self.short[order], self.places[order], self.weights[order]


def _best(scores: np.ndarray, names: list[str], top: int) -> np.ndarray:
    """Places of the ``top`` best scores, ties by name."""
    if len(scores) > top:
        least = np.partition(scores, -top)[-top]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return np.array(sorted(keep.tolist(), key=lambda i: (-scores[i], names[i]))[:top], np.int64)


class _Finder:
    """Best chunks per query over the shards of a task."""

    def __init__(self, asked: _Asked, avg_len: float, top: int):
        self.asked, self.avg_len, self.top = asked, avg_len, top
        self.best: list[list[tuple[float, str]]] = [[] for _ in asked.queries]
        self.short = Best(len(asked.short), top)
        self.counts = np.zeros((len(asked.queries), 4), np.int64)

    def threshold(self, query: int) -> float:
        found = self.best[query]
        return found[-1][0] - MARGIN if len(found) == self.top else -1.0

    def shard(self, chunks: pa.Array, words: dict[str, tuple]) -> None:
        if len(self.asked.short):
            self._together(chunks, words)
        of_query: dict[int, list[tuple]] = {}
        for word, held in words.items():
            for query, idf in self.asked.words.get(word, ()):
                of_query.setdefault(query, []).append((idf, held))
        if not of_query:
            return
        names = chunks.to_pylist()
        ranges = -(-len(names) // RANGE)
        scores = np.zeros(len(names))
        for query, held in of_query.items():
            if len(held) <= FEW and sum(len(w[3]) for _, w in held) <= WHOLE:
                self._whole(query, held, scores, names)
                continue
            # What a chunk of each range can reach at most.
            bound = np.zeros(ranges)
            for idf, (at, tops, *_) in held:
                bound[at] += idf * tops
            self.counts[query] += (sum(len(w[1]) for _, w in held), 0, sum(len(w[3]) for _, w in held), 0)
            held.sort(key=lambda w: len(w[1][3]))
            order = np.argsort(-bound, kind="stable")
            first, step = 0, STEP
            while first < ranges:
                open_now = order[first : first + step]
                first, step = first + step, 2 * step
                open_now = open_now[bound[open_now] >= max(self.threshold(query), 1e-12)]
                if not len(open_now):
                    break
                self._open(query, held, open_now, bound, names)

    def _together(self, chunks: pa.Array, words: dict[str, tuple]) -> None:
        """All queries of few words."""
        asked = self.asked
        held = sorted((asked.number[word], w) for word, w in words.items())
        word = np.repeat([n for n, _ in held], [len(w[3]) for _, w in held])
        local, sat = (np.concatenate([w[i] for _, w in held]) for i in (3, 4))
        lists = Lists(word, local.astype(np.int64), sat, len(asked.values), self.short.part(chunks))
        self.short.take(*lists.best(asked.places, asked.weights, self.short.floors, self.top))
        sizes = np.zeros((len(asked.values), 2), np.int64)
        sizes[[n for n, _ in held]] = [(len(w[1]), len(w[3])) for _, w in held]
        sums = (sizes[asked.places] * (asked.weights > 0)[:, :, None]).sum(axis=1)
        self.counts[asked.short] += sums[:, [0, 0, 1, 1]]

    def _whole(self, query: int, held: list[tuple], scores: np.ndarray, names: list[str]) -> None:
        """Full scores of all chunks with one of the words, rare words first; ``scores`` is zero before and after."""
        places = []
        for idf, (_, _, _, local, sat) in sorted(held, key=lambda w: len(w[1][3])):
            places.append(local[scores[local] == 0.0] if places else local)
            scores[local] += idf * sat
        chunk = np.concatenate(places)
        value = np.round(scores[chunk], 6)
        scores[chunk] = 0.0
        blocks = sum(len(w[1]) for _, w in held)
        postings = sum(len(w[3]) for _, w in held)
        self.counts[query] += (blocks, blocks, postings, postings)
        found = np.flatnonzero(value > max(self.threshold(query), 0.0))
        if len(found):
            self._keep(query, chunk[found], value[found], names)

    def _keep(self, query: int, chunk: np.ndarray, value: np.ndarray, names: list[str]) -> None:
        """The best of the chunks found go to the query's best so far."""
        if len(value) > self.top:
            hit = np.flatnonzero(value >= np.partition(value, -self.top)[-self.top])
            chunk, value = chunk[hit], value[hit]
        kept = _best(value, [names[c] for c in chunk.tolist()], self.top)
        both = self.best[query] + [(float(value[i]), names[int(chunk[i])]) for i in kept.tolist()]
        self.best[query] = sorted(both, key=lambda x: (-x[0], x[1]))[: self.top]

    def _open(self, query: int, held: list[tuple], opened: np.ndarray, bound: np.ndarray, names: list[str]) -> None:
        """Full scores of the chunks of some ranges, rare words first.

        After each word a range is closed whose best chunk so far cannot reach the threshold with the largest
        impacts of the words to come; so blocks of frequent words are opened only where a chunk still has a chance.
        """
        slot = np.full(len(bound), -1, np.int64)
        slot[opened] = np.arange(len(opened))
        rest, least = bound[opened].copy(), self.threshold(query)
        scores = np.zeros((len(opened), RANGE))
        flat = scores.ravel()
        for idf, (at, tops, ends, local, sat) in held:
            hit = np.flatnonzero(slot[at] >= 0)
            if not len(hit):
                continue
            starts, sizes = ends[hit], ends[hit + 1] - ends[hit]
            place = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
            where = local[place]
            flat[slot[where // RANGE] * RANGE + where % RANGE] += idf * sat[place]
            self.counts[query] += (0, len(hit), 0, len(place))
            rest[slot[at[hit]]] -= idf * tops[hit]
            if least > 0:
                closed = (scores.max(axis=1) + rest < least) & (slot[opened] >= 0)
                if closed.any():
                    slot[opened[closed]] = -1
                    scores[closed] = 0.0
                    rest[closed] = 0.0
        scores = flat
        found = np.flatnonzero(scores > max(self.threshold(query), 0.0))
        if len(found):
            chunk = opened[found // RANGE] * RANGE + found % RANGE
            self._keep(query, chunk, np.round(scores[found], 6), names)


def _found(batches: Iterator[pa.RecordBatch], known, avg_len: float, top: int, report: bool) -> Iterator[pa.RecordBatch]:
    """Shard rows to each task's best chunks, or to its counts of blocks and postings."""
    asked: _Asked = known.value
    finder, now, names, words = _Finder(asked, avg_len, top), None, None, {}
    for batch in batches:
        shard, term = batch.column(0).to_numpy(), batch.column(1)
        wanted = pc.fill_null(pc.or_kleene(pc.is_in(term, value_set=asked.values), pc.is_null(term)), True).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(wanted).tolist():
            if shard[i] != now:
                if words:
                    finder.shard(names, words)
                now, names, words = shard[i], None, {}
            if not term[i].is_valid:
                names = batch.column(2)[i].values
                continue
            at, tops, sizes, local, tf, dl = [batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in range(3, 9)]
            words[term[i].as_py()] = (at, tops, np.append(0, np.cumsum(sizes)), local, _saturated(tf.astype(float), dl, avg_len))
    if words:
        finder.shard(names, words)
    ids = pa.array(asked.queries, pa.string())
    if report:
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in finder.counts.T]], ["query_id", "blocks", "blocks_read", "postings", "postings_read"])
        return
    for q, chunks, scores in finder.short.rows():
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked.short[q])), chunks, pa.array(scores)], ["query_id", "chunk_id", "score"])
    for query, found in zip(asked.queries, finder.best):
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([query] * len(found)), pa.array([c for _, c in found]), pa.array([s for s, _ in found])], ["query_id", "chunk_id", "score"]
            )


def weighted_terms(terms: DataFrame, term_stats: DataFrame, n_chunks: int) -> DataFrame:
    """(query_id, term, idf) of the queries' words that the corpus has."""
    return terms.join(term_stats, "term").select("query_id", "term", inverse_frequency(F.col("df"), n_chunks).alias("idf"))


def pruned_topk(
    terms: DataFrame, shards: DataFrame, term_stats: DataFrame, n_chunks: int, avg_len: float, top: int,
    report: bool = False, limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``top`` best chunks per query, equal to ranking all scores.

    ``terms`` has the queries' distinct words; they are counted and go to the tasks in groups of whole queries of about
    ``limit`` rows, one scan of the shards each. For each query a task adds up the largest impacts of the query's blocks by
    range: a bound on what a chunk there can score. Ranges are opened from the best bound on, until the next bound lies below
    the task's ``top``-th score so far, and closed again as soon as no chunk in them can reach it; the blocks of the
    rest are never opened. Queries without a known word give no rows.
    With ``report`` the result is (query_id, blocks, blocks_read, postings, postings_read).
    """
    if top < 1:
        return terms.select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    spark = shards.sparkSession
    ship_package(spark)
    weighted = spill(weighted_terms(terms, term_stats, n_chunks), "query_terms")
    groups = 1 if bounded_count(weighted, limit) is not None else math.ceil(weighted.count() / limit)
    columns = ["shard", "term", "chunk_ids", "ranges", "tops", "sizes", "locals", "tfs", "dls"]
    schema = "query_id string, chunk_id string, score double"
    if report:
        schema = "query_id string, blocks long, blocks_read long, postings long, postings_read long"
    found = None
    for group in range(groups):
        mine = weighted if groups == 1 else weighted.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group)
        known = spark.sparkContext.broadcast(_Asked(mine.toPandas()))
        part = shards.select(*columns).mapInArrow(lambda b, k=known: _found(b, k, avg_len, top, report), schema)
        found = part if found is None else found.union(part)
    if report:
        sums = [F.sum(c).alias(c) for c in ("blocks", "blocks_read", "postings", "postings_read")]
        return found.groupBy("query_id").agg(*sums)
    return top_by_query(found, top, parts=1)
