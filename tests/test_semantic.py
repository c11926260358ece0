import random

import numpy as np
import pytest
from test_search import chunk_rows

from quarrylight.operators import semantic
from quarrylight.operators.embed import get_embedder
from quarrylight.plans.index import build_index
from quarrylight.session import scratch_path

TOPICS, WORDS = 8, 12


def corpus(rnd, n):
    """(topic, text): each text draws a few of its topic's words, so that two texts of a topic share few or none."""
    out = []
    for i in range(n):
        topic = i % TOPICS
        own = rnd.sample([f"topic{topic}word{k}" for k in range(WORDS)], 3)
        out.append((topic, " ".join([*own, rnd.choice(["common", "filler", "noise"])])))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    texts = corpus(random.Random(3), 400)
    index = build_index(chunk_rows(spark, [t for _, t in texts] + [""]), scratch_path(spark, "semantic"))
    found = semantic.fit(index.table("terms"), index.table("term_stats"), index.stats["n_chunks"], dimensions=10, part=150)
    return texts, index, found


def test_singular_values_equal_those_of_numpy(fitted):
    _, index, found = fitted
    words = semantic.vocabulary(index.table("term_stats"), index.stats["n_chunks"])
    rows = semantic.tfidf(index.table("terms"), words, index.stats["n_chunks"]).collect()
    names = {c: i for i, c in enumerate(sorted({r["chunk_id"] for r in rows}))}
    dense = np.zeros((len(names), max(r["column"] for r in rows) + 1))
    for r in rows:
        dense[names[r["chunk_id"]], r["column"]] = r["weight"]
    assert np.allclose((dense * dense).sum(axis=1), 1.0)
    assert np.allclose(found.values, np.linalg.svd(dense, compute_uv=False)[:10], rtol=0.01)
    vectors = np.array([r["vector"] for r in found.words.orderBy("column").collect()], float)
    assert np.allclose(vectors.T @ vectors, np.eye(10), atol=1e-4)


def test_recall_of_a_topic_is_above_that_of_hashed_words(spark, fitted):
    texts, index, found = fitted
    probes = corpus(random.Random(99), 40)
    asked = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(probes)], "id long, text string")
    near = {r["id"]: np.array(r["vector"]) for r in found.of_texts(asked, "id", "text").collect()}
    held = {r["chunk_id"]: np.array(r["vector"]) for r in found.of_counted(index.table("terms")).collect()}
    items = np.stack([held[f"c{i}"] for i in range(1, 401)])
    hashed = get_embedder().encode([t for _, t in texts])
    topics = np.array([t for t, _ in texts])

    def hits(matrix, vectors):
        return np.mean([(topics[np.argsort(-(matrix @ v), kind="stable")[:10]] == t).mean() for v, (t, _) in zip(vectors, probes)])

    ours = hits(items, [near[i] for i in range(40)])
    assert ours > 0.9 and ours > hits(hashed, get_embedder().encode([t for _, t in probes]))


def test_cases(spark, fitted):
    _, index, found = fitted
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "unheard words"), (4, "topic1word1 " * 500)], "id long, text string")
    rows = {r["id"]: np.array(r["vector"]) for r in found.of_texts(asked, "id", "text").collect()}
    assert all(not rows[i].any() for i in (1, 2, 3)) and abs(np.linalg.norm(rows[4]) - 1) < 1e-5
    none = build_index(chunk_rows(spark, ["alone", ""]), scratch_path(spark, "semantic"))
    assert semantic.fit(none.table("terms"), none.table("term_stats"), 2) is None


def test_small_matrices_are_added_up_by_all_tasks_at_once(spark, monkeypatch):
    """No job per part of the matrix, and a part's rows are packed once."""
    squares = [np.arange(4.0) * i for i in range(1, 8)]
    pieces = spark.createDataFrame([(0, bytearray(x.tobytes())) for x in squares], "block long, data binary").repartition(5)
    monkeypatch.setattr(type(pieces), "toLocalIterator", None)
    assert np.array_equal(semantic._sum_of_squares(pieces, 2), sum(squares).reshape(2, 2))
    rows = [(0, [1, 3], [0.5, 0.25]), (0, [2], [1.0]), (1, [0], [2.0])]
    packed = semantic._packed(spark.createDataFrame(rows, "part int, columns array<int>, weights array<double>"))
    assert sorted(r["part"] for r in packed.collect()) == [0, 1]
    there, held = semantic._times(packed.filter("part = 0").toArrow(), np.arange(8.0).reshape(4, 2))
    assert sorted(map(list, there)) == [[2.5, 3.25], [4.0, 5.0]] and len(held) == 2


def test_tfidf_shuffles_whole_chunks_once(spark):
    index = build_index(chunk_rows(spark, ["a b b", "a c", "b c c d", ""]), scratch_path(spark, "semantic"))
    words = semantic.vocabulary(index.table("term_stats"), 4)
    plan = semantic.tfidf(index.table("terms"), words, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") > plan.index("Generate explode(terms")
