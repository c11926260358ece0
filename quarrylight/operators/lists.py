"""The best places of very many short queries over a part of the corpus, all queries at once.

A query is a few words with weights; a place scores the sum of its words' values by these weights. A word's values lie in
descending order. A place that reaches a query's floor has its share of it from at least one word, so only the heads
of the words' lists down to these shares are opened, and the full scores are looked up for the places found there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words of a short query.
FEW = 4
SCORE_DIGITS = 6
# Scores are rounded to 1e-6; what cannot come within this of the floor cannot tie with it either.
MARGIN = 1e-5
# Places opened at a time.
OPEN = 1 << 20


def _runs(q: np.ndarray) -> np.ndarray:
    """Position of each row among the rows of its query; rows lie by query."""
    return np.arange(len(q)) - np.searchsorted(q, q, side="left")


class Lists:
    """Values other than zero of ``words`` words at places, given by word, then place.

    ``rank`` is each place's position by name. ``value_at(words, places)`` gives values, zero where there is none.
    """

    def __init__(self, word: np.ndarray, place: np.ndarray, value: np.ndarray, words: int, rank: np.ndarray,
                 value_at: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        self.rank = rank
        # Every word has a stretch of keys of its own, with room for bounds above all values.
        self.level = max(1.0, 2 * float(np.abs(value).max(initial=0.0)))
        key = self._key(word, value)
        order = np.argsort(key, kind="stable")
        self.key, self.place, self.value = key[order], place[order], value[order]
        self.ends = np.searchsorted(word, np.arange(words + 1))
        self.positive = np.diff(np.append(0, np.cumsum(value > 0))[self.ends])
        self._held = word * np.int64(max(len(rank), 1)) + place, value
        self.value_at = value_at or self._look_up

    def _key(self, word: np.ndarray, value: np.ndarray) -> np.ndarray:
        return word * (2 * self.level) + (self.level - value)

    def _look_up(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        known, value = self._held
        if not len(known):
            return np.zeros(len(place))
        wanted = word * np.int64(len(self.rank)) + place
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, value[at], 0.0)

    def best(self, words: np.ndarray, weights: np.ndarray, floors: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, rounded score), by query: the ``top`` best places with a positive score that reaches the query's
        floor, ties by name.

        ``words`` and ``weights`` have a row per query; columns that a query does not need have the weight 0.
        """
        up = weights > 0
        first = np.where(up, self.ends[words], self.ends[words + 1] - 1)
        size = self.ends[words + 1] - self.ends[words]
        limit = np.where(up, self.positive[words], np.where(weights < 0, size - self.positive[words], 0))
        floors = np.maximum(floors, 0.0)
        unknown = floors == 0
        for j in range(words.shape[1]):
            # A first floor: the last of the best among the first places of one list.
            new = np.flatnonzero(unknown & (limit[:, j] >= top))
            for rows in self._portions(new, np.minimum(limit[new, j : j + 1], 2 * top)):
                count = np.minimum(limit[rows, j], 2 * top)
                at = self.place[self._opened(first[rows, j], count, up[rows, j])]
                score = sum(
                    np.repeat(weights[rows, other], count) * self.value_at(np.repeat(words[rows, other], count), at)
                    for other in range(words.shape[1])
                )
                wide = np.full((len(rows), 2 * top), np.inf)
                wide[np.repeat(np.arange(len(rows)), count), np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)] = -score
                least = -np.partition(wide, top - 1, axis=1)[:, top - 1]
                floors[rows] = np.maximum(floors[rows], np.round(least, SCORE_DIGITS))
        heads, bounds = self._heads(words, weights, first, limit, floors)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for rows in self._portions(np.arange(len(words)), heads):
            parts = []
            for j in range(words.shape[1]):
                count = heads[rows, j]
                opened = self._opened(first[rows, j], count, up[rows, j])
                at, total = self.place[opened], None
                for other in range(words.shape[1]):
                    held = self.value[opened] if other == j else self.value_at(np.repeat(words[rows, other], count), at)
                    score = np.repeat(weights[rows, other], count) * held
                    total = score if total is None else total + score
                hit = np.flatnonzero(total >= np.repeat(floors[rows] - MARGIN, count))
                q, at, score = np.repeat(rows, count)[hit], at[hit], np.round(total[hit], SCORE_DIGITS)
                keep = (score >= floors[q]) & (score > 0)
                for other in range(j):
                    # A place in the heads of several lists counts in the first of them.
                    weight, held = weights[q, other], self.value_at(words[q, other], at)
                    key, bound = self._key(words[q, other], held), bounds[q, other]
                    keep &= ~np.where(weight > 0, (held > 0) & (key <= bound), (weight < 0) & (held < 0) & (key >= bound))
                parts.append((q[keep], at[keep], score[keep]))
            found.append(self._cut(*(np.concatenate(c) for c in zip(*parts)), top))
        return tuple(np.concatenate(c) for c in zip(*found))

    def _heads(self, words: np.ndarray, weights: np.ndarray, first: np.ndarray, limit: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many places of each list are opened, and the key down to which: the split of the floor that opens fewest.

        A place that gets less than its share from each word stays below the floor, and so does one that gets too little
        from a word for the largest values of all others.
        """
        used = limit > 0
        n = np.maximum(used.sum(axis=1, keepdims=True), 1)
        least = np.maximum(floors * (1 - 1e-9) - MARGIN, 0.0)[:, None]
        most = np.where(used, weights * self.value[np.where(used, first, 0)], 0.0) if len(self.value) else np.zeros(weights.shape)
        needed = least - (most.sum(axis=1, keepdims=True) - most) - MARGIN
        even = used / n
        splits = [even]
        for j in range(words.shape[1] if words.shape[1] > 1 else 0):
            for part in (0.5, 1.0):
                moved = part * even[:, j : j + 1]
                split = even + np.where(used & used[:, j : j + 1] & (n > 1), moved / np.maximum(n - 1, 1), 0.0)
                split[:, j] = np.where(n[:, 0] > 1, even[:, j] - moved[:, 0], even[:, j])
                splits.append(split)
        best, bounds, fewest = None, None, None
        for split in splits:
            share = np.maximum(split * least, needed)
            value = np.divide(share, weights, out=np.zeros(weights.shape), where=weights != 0)
            key = self._key(words, np.clip(value, -0.99 * self.level, 0.99 * self.level))
            heads = np.where(
                weights > 0, np.searchsorted(self.key, key, side="right") - first, first + 1 - np.searchsorted(self.key, key, side="left")
            )
            heads = np.clip(heads, 0, limit)
            total = heads.sum(axis=1)
            if best is None:
                best, bounds, fewest = heads, key, total
            else:
                fewer = total < fewest
                best[fewer], bounds[fewer], fewest[fewer] = heads[fewer], key[fewer], total[fewer]
        return best, bounds

    def _portions(self, rows: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """The rows in portions that open about ``OPEN`` places."""
        own = counts.sum(axis=1)
        portion = (np.cumsum(own) - own) // OPEN
        cuts = np.flatnonzero(np.diff(portion)) + 1
        return (part for part in np.split(rows, cuts) if len(part))

    def _opened(self, first: np.ndarray, count: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Where the first ``count`` entries of some lists stand, upwards or downwards."""
        begin = np.cumsum(count) - count
        step = np.arange(int(count.sum()))
        if up.all():
            return step + np.repeat(first - begin, count)
        sign = np.where(up, 1, -1)
        return np.repeat(first - sign * begin, count) + np.repeat(sign, count) * step

    def _cut(self, q: np.ndarray, place: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.rank[place], -score, q))
        order = order[_runs(q[order]) < top]
        return q[order], place[order], score[order]


class Best:
    """The ``top`` best places of each query over the parts of a task, ties by name."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.score = np.full((queries, top), -np.inf)
        self.place = np.full((queries, top), -1, np.int64)
        self.names, self.rank, self.first = pa.array([], pa.string()), np.zeros(0, np.int64), 0

    @property
    def floors(self) -> np.ndarray:
        """Each query's last score; minus infinity where there are fewer than ``top``."""
        return self.score[:, -1]

    def part(self, names: pa.Array) -> np.ndarray:
        """Begins a part; gives its places' positions by name among all so far."""
        self.first = len(self.names)
        self.names = pa.concat_arrays([self.names, names.cast(pa.string())])
        order = pc.array_sort_indices(self.names, order="ascending", null_placement="at_start").to_numpy()
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        return self.rank[self.first :]

    def take(self, q: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        """Places of this part, at most ``top`` per query, by query."""
        asked, row = np.unique(q, return_inverse=True)
        place = place + self.first
        for low in range(0, len(asked), 1 << 15):
            mine = slice(*np.searchsorted(row, [low, low + (1 << 15)]))
            some = asked[low : low + (1 << 15)]
            new_score, new_place = np.full((len(some), self.top), -np.inf), np.full((len(some), self.top), -1, np.int64)
            cells = row[mine] - low, _runs(row[mine])
            new_score[cells], new_place[cells] = score[mine], place[mine]
            scores = np.concatenate([self.score[some], new_score], axis=1)
            places = np.concatenate([self.place[some], new_place], axis=1)
            order = np.lexsort((np.where(places < 0, len(self.rank), self.rank[places]), -scores), axis=-1)[:, : self.top]
            self.score[some] = np.take_along_axis(scores, order, axis=1)
            self.place[some] = np.take_along_axis(places, order, axis=1)

    def rows(self, step: int = 1000) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(query, name, score) of all that was found, some queries at a time."""
        for low in range(0, len(self.score), step):
            q, cell = np.nonzero(self.place[low : low + step] >= 0)
            if len(q):
                yield q + low, self.names.take(pa.array(self.place[low : low + step][q, cell])), self.score[low : low + step][q, cell]
