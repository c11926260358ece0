import hashlib
import heapq
import itertools
import random
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import conversations as C
from quarrylight.llm.oracles import OP12

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, edits) by best-first search over whole edit strings."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, edits
        due = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, edits + "I", i, due))
        if i < len(rows):
            fault, initial = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state))
            if fault in (C.FINE, C.CUT):
                more = 5 if fault == C.CUT else 0
                if (state, initial) in STEP:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, STEP[state, initial]))
                heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, due))


def test_every_short_conversation():
    kinds = [(f, r) for f in (C.FINE, C.BLANK, C.CUT) for r in "suax"]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            assert C.Search(list(rows)).best() == cheapest(rows)


def test_random_conversations_across_anchors(monkeypatch):
    rng = random.Random(5)
    for anchor in (1, 3, 64):
        monkeypatch.setattr(C, "ANCHOR", anchor)
        for _ in range(150):
            rows = [(rng.choice([0, 0, 0, 0, 1, 2, 3]), rng.choice(["s", "u", "a", "u", "a", ""])) for _ in range(rng.randint(0, 30))]
            assert C.Search(rows).best() == cheapest(rows)


def test_search_is_linear_in_the_rows():
    rng = random.Random(9)
    rows = [(rng.choice([0, 0, 0, 1, 3]), rng.choice("uas")) for _ in range(20_000)]
    search = C.Search(rows)
    steps, plain = 0, search.edits

    def counted(i, state):
        nonlocal steps
        steps += 1
        return plain(i, state)

    search.edits = counted
    cost, edits = search.best()
    assert steps < 100 * len(rows) and len(edits.replace("I", "")) == len(rows) and cost > 0


def plain_report(rows):
    """conv -> the report of the contract, row by row in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(hit, text)
            kept += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in kept:
            end = text.rstrip(" \t\n\x0b\f\r")
            faults.append(C.BLANK if not end else C.DUPLICATE if (role, text) in seen else C.FINE if end[-1] in ".!?" else C.CUT)
            seen.add((role, text))
        cost, edits = cheapest([(f, r[1][:1]) for f, r in zip(faults, kept)])
        lines = [f"{role}:{'' if at is None else kept[at][2]}" for at, role in C.outcome([r[1] for r in kept], edits)]
        turns = {r[0] for r in kept if r[0] is not None}
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in (1, 2, 3)],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:])), cost, edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


SCHEMA = "conv_id long, turn long, role string, text string, copy int, `a.b` string"


def report(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_report_equals_plain_version(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Why?  \n", "cut off", "", " \t", "…", None, "Well, yes.", "日本語。", "x" * 20000 + "."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", "system", "tool", None, "user"]), rng.choice(texts)))
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(7)
    assert report(C.repair_report(C.damaged(docs))) == plain_report(rows)


def test_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.repair_report(C.damaged(none)).count() == 0 and C.repair(C.as_given(none)).count() == 0
    gone = [(i, 0, "user", "Hi.", 0, "") for i in range(3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    got = report(C.repair_report(C.damaged(spark.createDataFrame(gone, SCHEMA))))
    assert len(got) == len(gone) > 50
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind.", 0, ""), (1, 1, "user", "Hi!", 0, ""), (1, 2, "user", "Hi!", 0, ""), (1, 3, "user", "More?", 0, ""),
            (2, 0, "assistant", "Hello.", 0, ""), (2, 1, "user", "", 0, ""), (3, 0, "user", "Ok.", 0, "")]
    got = {}
    fixed = C.repair(C.as_given(spark.createDataFrame(rows, SCHEMA)))
    for r in sorted(fixed.collect()):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"], r["inserted"]))
    assert got == {1: [("system", "Be kind.", False), ("user", "Hi!", False), ("assistant", "More?", False)]}
    assert fixed.groupBy("conv_id").agg(F.max("place")).first()[1] == 2


def test_long_conversation(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Line {t}." if t % 7 else f"Line {t}", 0, "") for t in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert report(C.repair_report(C.damaged(docs))) == plain_report([r[:4] for r in rows])


@pytest.mark.parametrize("n", [1, 9])
def test_equal_to_sql(spark, small, n):
    from quarrylight.llm.queries import op12_conversation_repair

    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        assert compare.mismatch(op12_conversation_repair(spark, small), compare.connect(small), OP12) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
