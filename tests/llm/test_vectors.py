import math

import numpy as np
import pytest

from quarrylight.llm import vectors


def naive(rows, cosine=0.95):
    """(id, links, component, kept) by comparing everything with everything."""
    unit = []
    for _, v in rows:
        fine = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float64) if fine else None
        unit.append(x / np.linalg.norm(x) if fine else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    group = [None] * n
    for i in range(n):
        if group[i] is None:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
            for k in seen:
                group[k] = least
    return sorted([(rows[i][0], len(near[i]), group[i], rows[i][0] == group[i]) for i in range(n)], key=str)


def cluster_rows(rng, n, dims=64, first=0):
    centres = rng.normal(size=(max(1, n // 12), dims))
    out = []
    for i in range(n):
        c = centres[rng.integers(len(centres))]
        out.append((first + i, [float(np.float32(x)) for x in c + rng.normal(size=dims) * rng.choice([0.0, 0.1, 0.2, 0.24, 0.9])]))
    return out


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("piece", [2048, 16])
def test_links_equal_brute_force(spark, piece):
    rng = np.random.default_rng(1)
    rows = cluster_rows(rng, 500)
    odd = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] + [1.0] * 63), (904, [None] + [1.0] * 63), (905, [float("inf")] + [1.0] * 63),
           (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [5.0]), (None, rows[3][1]), (2, rows[9][1]), (2, rows[9][1]), (None, [0.0] * 64), (909, [-0.0, 1.0]), (910, [0.0, 1.0])]
    rows += odd
    got = vectors.linked_vectors(spark.createDataFrame(rows, SCHEMA), piece=piece).collect()
    got = sorted([tuple(r) for r in got], key=str)
    want = naive(rows)
    # the hashing may miss a pair; none may be invented
    same = sum(a == b for a, b in zip(got, want))
    assert len(got) == len(want)
    assert same >= 0.99 * len(want)
    assert sum(r[1] for r in got) <= sum(r[1] for r in want)
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want)


def test_recall_at_the_bound():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * side / np.linalg.norm(side, axis=1)[:, None]
    hashed = [vectors.buckets(x, vectors.TABLES, vectors.POLYTOPES, vectors.PROBES, vectors.SEED) for x in (a, b)]
    found = np.stack([vectors._meet(hashed[0][:, t], hashed[1][:, t]) for t in range(vectors.TABLES)]).any(axis=0)
    assert found.mean() >= 0.999


def test_copies_count_without_pairs(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(2000)] + [(5000, [1.0, 2.0, 3.01])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.linked_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (2000, 0) for i, _ in rows}


def test_empty_table_and_clashing_names(spark):
    assert vectors.linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 0.0], 5, "x"), (2, [1.0, 0.01], 6, "y")], "vec_id long, embedding array<double>, key int, n_links string")
    assert sorted(tuple(r) for r in vectors.linked_vectors(rows).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(vectors._hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(vectors._hadamard(vectors._hadamard(x)), x)
