import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylight.llm import components, simhash


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_groups(points, radius=2):
    group = {p: p for p in points}

    def top(p):
        while group[p] != p:
            p = group[p]
        return p

    for a in points:
        for b in points:
            if (a ^ b).bit_count() <= radius:
                group[top(a)] = top(b)
    return {p: top(p) for p in points}


@pytest.mark.parametrize("text", ["", "  ", "One", "one TWO", "a b c", "Ä ö ü x\ty\vz\n a a a a a a", "w " * 5000])
def test_fingerprint_matches_the_definition(text):
    assert simhash.fingerprint(text.encode()) == naive_fingerprint(text)


def test_blocks_cut_no_shingle(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "c", "dd"]) + str(rng.randrange(50)) for _ in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 50)
    assert simhash.fingerprint(text.encode()) == whole == naive_fingerprint(text)


def near_points(rng, n, spread):
    base = [rng.getrandbits(64) for _ in range(max(1, n // 20))]
    out = set()
    while len(out) < n:
        p = rng.choice(base)
        for _ in range(rng.randrange(spread)):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return sorted(out)


def test_tree_finds_all_within_radius():
    points = near_points(random.Random(2), 700, 8)
    array = np.array(points, np.uint64)
    found = set(zip(*(x.tolist() for x in simhash.BkTree(array).within(array, 2))))
    want = {(i, j) for i, a in enumerate(points) for j, b in enumerate(points) if (a ^ b).bit_count() <= 2}
    assert found == want


def test_shard_groups_equal_naive_groups():
    points = near_points(random.Random(3), 400, 9)
    label = simhash.shard_groups(np.array(points, np.uint64))
    naive = naive_groups(points)
    assert len(set(label.tolist())) == len(set(naive.values()))
    assert all(naive[points[i]] == naive[points[k]] for i, k in enumerate(label))


@pytest.mark.parametrize("shard", [1024, 3])
def test_links_connect_what_brute_force_connects(spark, shard):
    points = near_points(random.Random(4), 500, 7)
    signed = [int(np.uint64(p).view(np.int64)) if False else (p if p < 1 << 63 else p - (1 << 64)) for p in points]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.fingerprint_links(fps, shard=shard)
    of = {r["node"]: r["component"] for r in components.components(links, "a", "b").collect()}
    naive = naive_groups(points)
    ours = {}
    for p, s in zip(points, signed):
        ours.setdefault(of.get(s, s), set()).add(p)
    want = {}
    for p, g in naive.items():
        want.setdefault(g, set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, want.values()))


ROWS = [
    (5, "the quick brown fox jumps", "a", 1), (3, "The QUICK brown fox  jumps", "b", 2), (3, "The QUICK brown fox  jumps", "b", 2),
    (9, None, "c", 3), (8, "", "c", 4), (None, "  \n", "d", 5), (7, "something else entirely different here", None, 6),
    (None, "no id but words of its own", "e", 7), (11, "x" * 200_000 + " y z", "f", 8),
]


def test_near_duplicates_of_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, fp string, component_id int")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    want = sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (None, 8), (7, 7), (None, None), (11, 11)], key=str)
    assert got == want


def test_keep_one_keeps_columns_and_smallest_id(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, fp string, component_id int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[0] for r in kept.collect()), key=str) == sorted([3, 8, 7, None, 11], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_a_large_group_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same words in every row").alias("text"))
    rows = simhash.near_duplicates(docs).groupBy("component_id").count().collect()
    assert [tuple(r) for r in rows] == [(0, 3000)]


def test_components_of_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(20, 60)]
    links = spark.createDataFrame([*chain, *star, (1, 1), (None, 2)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links, "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in [7, *range(20, 60)]}, 1: 1}
