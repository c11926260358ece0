"""Repair of conversation structure: the cheapest edits of every conversation, found by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import ship_package

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# Rows between places from which the cheapest rest is found first; it keeps the search linear in the rows.
ANCHOR = 64
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

# The grammar of role initials, (s?(ua)+)?: begin, after a system row, after a user row, after an assistant row.
_BEGIN, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {(_BEGIN, "s"): _SYSTEM} | {(s, "u"): _USER for s in (_BEGIN, _SYSTEM, _ASSISTANT)} | {(_USER, "a"): _ASSISTANT}
_ENDS = (_BEGIN, _ASSISTANT)
_BLANKS = " \t\n\x0b\f\r"


class Search:
    """Iterative-deepening A* over the rows of one conversation: (fault, role initial) of each.

    A state is (rows used, grammar state). The table holds what is known of the cheapest way on from a state: at first
    the sum of what each row costs at least, and whenever a state fails within a bound, the
    least total that its edits could still give. A state whose entry exceeds what is left is not entered again.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        self.rows, self.n = rows, len(rows)
        self.least = [0] * (4 * (self.n + 1))

    def _estimate(self, start: int, stop: int) -> None:
        """Entries of the rows between two places: what they cost at least, and the cheapest way on from the second place."""
        rest = min(self.least[4 * stop : 4 * stop + 4])
        for i in range(stop - 1, start - 1, -1):
            rest += DELETE if self.rows[i][0] else 0
            self.least[4 * i : 4 * i + 4] = [rest] * 4

    def edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(edit, cost, rows used, grammar state) in ASCII order: D, I, K, R."""
        needed = _ASSISTANT if state == _USER else _USER
        if i == self.n:
            yield "I", INSERT, i, needed
            return
        fault, initial = self.rows[i]
        yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, needed
        if fault in (FINE, CUT):
            more = TRUNCATED if fault == CUT else 0
            if (state, initial) in _NEXT:
                yield "K", more, i + 1, _NEXT[state, initial]
            yield "R", REROLE + more, i + 1, needed

    def _first_within(self, start: int, state: int, bound: int, stop: int) -> tuple[str, int] | None:
        """The first path in edit order, and its last state, that leads to row ``stop`` and costs at most ``bound``
        with the way on from there, whose cost the table holds; None if there is none."""
        least, path = self.least, []
        # A frame: rows used, state, what is left, edits to come.
        frames = [(start, state, bound, self.edits(start, state))]
        if start == self.n and state in _ENDS:
            return "", state
        while frames:
            i, now, left, edits = frames[-1]
            for edit, cost, at, then in edits:
                if cost + least[4 * at + then] <= left:
                    path.append(edit)
                    if at == stop and (stop < self.n or then in _ENDS):
                        return "".join(path), then
                    frames.append((at, then, left - cost, self.edits(at, then)))
                    break
            else:
                # Failed: every edit was refused, or entered and failed itself, and then its entry has risen.
                rest = min(cost + least[4 * at + then] for _, cost, at, then in self.edits(i, now))
                least[4 * i + now] = max(least[4 * i + now], rest)
                frames.pop()
                if path:
                    path.pop()
        return None

    def _deepen(self, start: int, state: int, stop: int) -> tuple[str, int]:
        """Raises the bound to what the last search has learned until a path is found; then the entry is exact."""
        while True:
            found = self._first_within(start, state, self.least[4 * start + state], stop)
            if found is not None:
                return found

    def best(self) -> tuple[int, str]:
        """(cost, edits) of the cheapest repair; of several the first in ASCII order.

        Every ``ANCHOR`` rows, from the end on, the cost of the way on is made exact for each state, by searches that end at
        the next such place; so the path from the start is found piece by piece.
        """
        stops = [*range(ANCHOR, self.n, ANCHOR), self.n]
        for start, stop in reversed([*zip([0, *stops], stops)]):
            self._estimate(start, stop)
            for state in range(4) if start else (_BEGIN,):
                self._deepen(start, state, stop)
        at, state, path = 0, _BEGIN, []
        for stop in stops:
            piece, state = self._deepen(at, state, stop)
            path.append(piece)
            at = stop
        return self.least[_BEGIN], "".join(path)


def repaired(roles: list[str], faults: list[int]) -> tuple[int, str]:
    """(cost, edits) of one conversation's rows."""
    return Search([(f, r[:1]) for f, r in zip(faults, roles)]).best()


def outcome(roles: list[str], edits: str) -> list[tuple[int | None, str]]:
    """(row or None for an inserted one, role) of the repaired conversation."""
    out, i, state = [], 0, _BEGIN
    for edit in edits:
        needed = "assistant" if state == _USER else "user"
        if edit == "D":
            i += 1
            continue
        row, role = (None, needed) if edit == "I" else (i, roles[i] if edit == "K" else needed)
        i += edit != "I"
        state = _NEXT[state, role[:1]]
        out.append((row, role))
    return out


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` as (conv, turn, role, text, copy, there) with faults put in by the CRC-32 of ``conv:turn`` modulo 20.

    0 drops the row (it stays with ``there`` false), 1 empties the text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats the row,
    4 sets the role to user. A null role, text, or part of the key counts as one space.
    """
    held = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    turned = F.crc32(F.concat(held(conv), F.lit(":"), held(turn))) % 20
    body = F.when(F.col("turned") == 1, "").when(F.col("turned") == 2, F.translate(F.col("body"), ".!?", "")).otherwise(F.col("body"))
    return rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), held(role).alias("said"), held(text).alias("body"), turned.alias("turned")
    ).select(
        "conv", "turn", F.when(F.col("turned") == 4, "user").otherwise(F.col("said")).alias("role"), body.alias("text"),
        F.explode(F.when(F.col("turned") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("turned") != 0).alias("there"),
    )


def as_given(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``rows`` as :func:`damaged` returns them, without damage."""
    held = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), held(role).alias("role"), held(text).alias("text"),
        F.lit(0).alias("copy"), F.lit(True).alias("there"),
    )


_PAIRS = {"su", "ua", "au"}


def _twice(rows: DataFrame) -> DataFrame:
    """Rows of each conversation in order, each twice: first all without texts, then all with them.

    One shuffle by conversation; rows of one turn stand by role and digest of the text, so copies are adjacent.
    """
    end = F.rtrim(F.col("text"), F.lit(_BLANKS))
    marked = rows.select(
        "*", F.md5("text").alias("code"), (end != "").alias("solid"), F.right(end, F.lit(1)).isin(".", "!", "?").alias("ended"),
    ).withColumn("phase", F.explode(F.when(F.col("there"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    body = F.when(F.col("phase") == 1, F.col("text")).alias("text")
    return (
        marked.select("conv", "phase", "turn", "role", "code", "copy", "there", "solid", "ended", body)
        .repartition("conv")
        .sortWithinPartitions("conv", "phase", F.col("turn").asc_nulls_first(), "role", "code", "copy")
        .select("conv", "phase", "turn", "role", "code", "there", "solid", "ended", "text")
    )


class _Conversation:
    """What a task keeps of one conversation: a few numbers per row, no text."""

    def __init__(self):
        self.roles, self.faults, self.turns, self.seen = [], [], set(), set()
        self.cost, self.audit, self.plan, self.at, self.row = 0, "", None, 0, 0

    def meet(self, turn: int | None, role: str, code: str, solid: bool, ended: bool) -> None:
        self.faults.append(BLANK if not solid else DUPLICATE if (role, code) in self.seen else FINE if ended else CUT)
        self.seen.add((role, code))
        self.roles.append(role)
        if turn is not None:
            self.turns.add(turn)

    def solve(self) -> None:
        self.seen = set()
        self.cost, self.audit = repaired(self.roles, self.faults)
        self.plan = outcome(self.roles, self.audit)

    def rows_until(self, row: int, turn: int | None, text: str) -> Iterator[tuple]:
        """(place, role, text, turn, inserted) of the repaired rows up to the given one."""
        while self.at < len(self.plan) and self.plan[self.at][0] in (None, row):
            source, role = self.plan[self.at]
            yield (self.at, role, "", None, True) if source is None else (self.at, role, text, turn, False)
            self.at += 1

    def counts(self) -> tuple:
        initials = [r[:1] for r in self.roles]
        return (
            max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0,
            *[self.faults.count(f) for f in (BLANK, DUPLICATE, CUT)],
            sum(a + b not in _PAIRS for a, b in zip(initials, initials[1:])), self.cost, self.audit,
        )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, conversation, repaired row) for every repaired row, and (conv, conversation, None) at each conversation's end."""
    now, talk = None, None

    def rest(talk: _Conversation) -> Iterator[tuple]:
        if talk.plan is None:
            talk.solve()
        return talk.rows_until(-1, None, "")

    for batch in batches:
        for conv, phase, turn, role, code, there, solid, ended, text in zip(*[c.to_pylist() for c in batch.columns]):
            if talk is None or conv != now:
                if talk is not None:
                    yield from ((now, talk, r) for r in rest(talk))
                    yield now, talk, None
                now, talk = conv, _Conversation()
            if phase == 0:
                if there:
                    talk.meet(turn, role, code, solid, ended)
                continue
            if talk.plan is None:
                talk.solve()
            yield from ((now, talk, r) for r in talk.rows_until(talk.row, turn, text))
            talk.row += 1
    if talk is not None:
        yield from ((now, talk, r) for r in rest(talk))
        yield now, talk, None


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    for held in iter(lambda: list(islice(rows, size)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _run(rows: DataFrame, of, fields: str, conv: str) -> DataFrame:
    ship_package(rows.sparkSession)
    ddl = f"conv {rows.schema['conv'].dataType.simpleString()}, {fields}"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return _twice(rows).mapInArrow(lambda b: _batched(of(_stream(b)), schema), ddl).withColumnRenamed("conv", conv)


def repair(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The repaired rows: ``conv_id``, ``place`` from 0, ``role``, ``text``, ``turn`` (null where inserted), ``inserted``.

    ``rows`` come from :func:`as_given` or :func:`damaged`. Within a conversation rows stand by turn (null first), then role and
    text digest. A row is faulty if it is blank, else if role and text stood before, else if its last character that is no
    white space is none of ``.!?``; blank and repeated rows are deleted. Edits are delete, insert an empty row of the role due,
    keep, and change to the role due; the cheapest that give the role initials ``(s?(ua)+)?`` are taken, the first in ASCII order
    of their initials on a tie. A row whose role has no initial cannot be kept. Null conversation ids are one conversation.

    A task holds a few numbers per row of one conversation, never its texts: they come by in order after the search
    and go out as they come. A conversation is one task's work, as its rows depend on each other.
    """
    def of(stream):
        for conv_id, _, row in stream:
            if row:
                yield conv_id, *row

    return _run(rows, of, "place long, role string, text string, turn long, inserted boolean", conv)


def repair_report(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """A row per conversation: ``gaps`` in the turns, rows ``blank``, ``duplicate`` and ``truncated`` (first fault each), ``illegal``
    neighbours, ``cost`` and ``audit`` (initials of the edits) of the repair, and ``repaired_sha256`` of its ``role:text`` lines.

    Cases as in :func:`repair`; a conversation whose rows are all gone has zeros, an empty audit and the hash of nothing.
    """
    def of(stream):
        digest, first = hashlib.sha256(), True
        for conv_id, talk, row in stream:
            if row:
                digest.update(f"{'' if first else chr(10)}{row[1]}:{row[2]}".encode("utf-8", "surrogatepass"))
                first = False
            else:
                yield conv_id, *talk.counts(), digest.hexdigest()
                digest, first = hashlib.sha256(), True

    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return _run(rows, of, f"{counts}, audit string, repaired_sha256 string", conv)
