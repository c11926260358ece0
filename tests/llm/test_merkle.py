import hashlib
import random
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import merkle as M
from quarrylight.llm.oracles import OP13

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, key string, tree string, `a.b` int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, tampered=False):
    values = list(row[:5])
    if tampered and values[4] is not None:
        values[4] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values[4])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """(top, siblings of each leaf as lists by level of (own place, others))."""
    steps = [[] for _ in digests]
    level, members = digests, [[i] for i in range(len(digests))]
    while len(level) > 1:
        runs = [range(i, min(i + 16, len(level))) for i in range(0, len(level), 16)]
        for run in runs:
            for k in run:
                for m in members[k]:
                    steps[m].append((k - run[0], [level[j] for j in run if j != k]))
        level, members = [sha("".join(level[j] for j in run)) for run in runs], [[m for j in run for m in members[j]] for run in runs]
    return level[0], steps


def fold(digest, steps):
    for at, others in steps:
        digest = sha("".join([*others[:at], digest, *others[at:]]))
    return digest


def plain(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    tops = {}
    for s, members in sources.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops[s] = tree([leaf(r) for r in members])
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    root, over = tree([tops[s][0] for s in names])
    out = []
    for s, up in zip(names, over):
        for r, steps in zip(sources[s], tops[s][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            steps = steps + up
            folded = fold(leaf(r, hit), steps)
            proof = sha("".join(d for _, others in steps for d in others))
            out.append((r[0], leaf(r), tops[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def got(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in df.select(*names).collect()], key=str)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 273, 4096, 4097, 5000])
def test_positions_are_those_of_the_log(n):
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    levels = M.height(n)
    log = M.postorder(digests, levels)
    rows = [digests]
    while len(rows[-1]) > 1:
        rows.append([M.node(rows[-1][i : i + 16]) for i in range(0, len(rows[-1]), 16)])
    for level, row in enumerate(rows):
        assert [log[p] for p in M.position(level, range(len(row)), n, levels).tolist()] == row
    assert len(log) == sum(map(len, rows)) and log[-1].hex() == tree([d.hex() for d in digests])[0]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_equal_to_plain_version(spark, levels):
    rng = random.Random(levels)
    rows = [
        (rng.choice([i, i, 7, None]), rng.choice(["hot", "hot", "hot", "b", "é", "", None, f"s{i % 40}"]), rng.choice(["en", None, ""]),
         rng.choice([i, None, -5]), rng.choice([f"Text {i} ÄB", "", None, "SAME"]), "k", "t", 1)
        for i in range(900)
    ]
    rows += [rows[0]] * 40 + [(5, "lone", None, None, None, "k", "t", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(M.tampered_proofs(docs, levels=levels)) == plain([r[:5] for r in rows])


def test_manifest_catches_changes(spark):
    rows = [(i, "a", "en", 1, f"Word {i}", "k", "t", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    proofs = M.build(docs).proofs()
    assert proofs.where("NOT verified").count() == 0
    other = M.build(docs.withColumn("text", F.when(F.col("doc_id") == 3, "word 3").otherwise(F.col("text"))))
    assert other.root != bytes.fromhex(proofs.first()["root"])


def test_cases(spark):
    assert M.tampered_proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(1, None, None, None, "A" * 100000, "k", "t", 1)]
    assert got(M.tampered_proofs(spark.createDataFrame(one, SCHEMA))) == plain([r[:5] for r in one])


def test_equal_to_sql(spark, small):
    from quarrylight.llm.queries import op13_merkle_manifest

    assert compare.mismatch(op13_merkle_manifest(spark, small), compare.connect(small), OP13) is None
