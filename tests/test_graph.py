import random

import pytest

from quarrylight.contracts import CHUNK
from quarrylight.operators import concepts as C
from quarrylight.operators import expansion as X
from quarrylight.operators.communities import detect_communities, modularity
from quarrylight.operators.ranking import distributed_rank
from quarrylight.plans.graph import build_graph, graph_hits, graph_search, open_graph
from quarrylight.plans.index import build_index
from quarrylight.plans.search import QueryBatch
from quarrylight.recipe import GraphSettings
from quarrylight.session import scratch_path
from pyspark.sql import functions as F

INC = "concept string, chunk_id string, doc_id string, freq long"


def test_phrases(spark):
    df = spark.createDataFrame([("The multivariable regression models, the model and analysis of 3 outcomes.",)], "t string")
    got = df.select(C.phrases(F.col("t"))).first()[0]
    assert got == ["multivariable regression model", "outcome"]


def test_cooccurrence_golden(spark):
    doc = {"1": "P", "2": "Q", "3": "P"}
    freq = {"x": 3, "y": 2, "z": 1}
    data = [(c, k, doc[k], freq[c]) for c, ks in {"x": "123", "y": "12", "z": "3"}.items() for k in ks]
    edges = C.prune_edges(C.cooccurrence(spark.createDataFrame(data, INC)), 2)
    assert [tuple(r) for r in edges.collect()] == [("x", "y", 2, 2)]
    assert sorted(r[0] for r in C.nodes_of(edges).collect()) == ["x", "y"]


def test_cap_keeps_rarest(spark):
    data = [(c, "1", "d", f) for c, f in (("a", 9), ("b", 1), ("c", 1), ("d", 5))]
    edges = C.cooccurrence(spark.createDataFrame(data, INC), per_chunk=3)
    assert sorted((r["a"], r["b"]) for r in edges.collect()) == [("b", "c"), ("b", "d"), ("c", "d")]


def naive_bfs(seeds, edges, home, relevant, budget, hops, decay, carries, chunk_budget):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    rel, frontier = dict(seeds), list(seeds)
    visited = set(seeds)
    for _ in range(hops):
        if len(visited) >= budget:
            break
        fresh = []
        for u in sorted(frontier, key=lambda n: (-rel[n], n)):
            for v in sorted(near.get(u, {})):
                if v in visited or home[v] not in relevant or len(visited) >= budget:
                    continue
                rel[v] = rel[u] * (near[u][v] / max(near[u].values())) * decay
                visited.add(v)
                fresh.append(v)
        if len({c for n in visited for c in carries.get(n, ())}) >= chunk_budget:
            break
        frontier = fresh
    return {n: round(rel[n], 9) for n in visited}


def test_expansion_equals_sequential_walk(spark):
    rnd = random.Random(3)
    cases = {}
    names = [f"n{i}" for i in range(14)]
    edges = {tuple(sorted(rnd.sample(names, 2))): rnd.randint(1, 5) for _ in range(40)}
    edges = [(a, b, w) for (a, b), w in edges.items()]
    home = {n: rnd.randint(0, 3) for n in names}
    carries = {n: {f"k{rnd.randint(0, 20)}" for _ in range(3)} for n in names}
    seeds, relevant = [], []
    for q in range(25):
        picked = rnd.sample(names, rnd.randint(1, 3))
        sims = {n: round(rnd.random(), 3) for n in picked}
        allowed = set(rnd.sample(range(4), 2)) | {home[n] for n in picked}
        cases[f"q{q}"] = (sims, allowed)
        seeds += [(f"q{q}", n, s) for n, s in sims.items()]
        relevant += [(f"q{q}", c) for c in allowed]
    g = GraphSettings(budget_concepts=7, budget_chunks=14, max_hops=3)
    got = {}
    out = X.expand(
        spark.createDataFrame(seeds, "query_id string, concept string, sim double"),
        spark.createDataFrame(edges, "a string, b string, weight int"),
        spark.createDataFrame(list(home.items()), "concept string, community int"),
        spark.createDataFrame(relevant, "query_id string, community int"),
        spark.createDataFrame([(n, k) for n, ks in carries.items() for k in ks], "concept string, chunk_id string"),
        g,
    )
    for r in out.collect():
        got.setdefault(r["query_id"], {})[r["concept"]] = round(r["rel"], 9)
    for q, (sims, allowed) in cases.items():
        assert got[q] == naive_bfs(sims, edges, home, allowed, 7, 3, 0.5, carries, 14), q


def test_activation_golden(spark):
    out = X.expand(
        spark.createDataFrame([("q", "u", 0.9)], "query_id string, concept string, sim double"),
        spark.createDataFrame([("u", "v", 4), ("u", "w", 2)], "a string, b string, weight int"),
        spark.createDataFrame([("u", 0), ("v", 0), ("w", 1)], "concept string, community int"),
        spark.createDataFrame([("q", 0), ("q", 1)], "query_id string, community int"),
        spark.createDataFrame([("u", "k")], "concept string, chunk_id string"),
    )
    assert {r["concept"]: round(r["rel"], 6) for r in out.collect()} == {"u": 0.9, "v": 0.45, "w": 0.225}


def test_accumulation_golden(spark):
    active = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.4)], "query_id string, concept string, rel double")
    inc = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("a", "k2")], "concept string, chunk_id string")
    got = {r["chunk_id"]: r["score_a"] for r in X.accumulate(active, inc).collect()}
    assert got == {"k1": 1.728459, "k2": 1.08715}


def test_rows_per_query_and_chunk_are_not_shuffled(spark):
    """Places of active concepts meet by chunk; what queries make of them stays there. Chunk ids may repeat or be null."""
    active = spark.createDataFrame([("q1", "a", 1.0), ("q1", "b", 0.5), ("q2", "b", 2.0)], "query_id string, concept string, rel double")
    rows = [("a", "c1"), ("b", "c1"), ("b", "c1"), ("b", "c2"), ("b", None), ("z", "c3"), (None, "c1")]
    found = X.accumulate(active, spark.createDataFrame(rows, "concept string, chunk_id string"), 0.0)
    got = {(r["query_id"], r["chunk_id"]): (r["hits"], r["score_a"]) for r in found.collect()}
    assert got == {("q1", "c1"): (3, 2.0), ("q1", "c2"): (1, 0.5), ("q1", None): (1, 0.5),
                   ("q2", "c1"): (2, 4.0), ("q2", "c2"): (1, 2.0), ("q2", None): (1, 2.0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and "hashpartitioning(query_id" not in plan


def test_distributed_rank_over_one_hot_group(spark):
    data = [("hot", i) for i in range(500)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(data, "g string, v int").repartition(5)
    got = distributed_rank(df, ["g"], [F.desc("v")]).collect()
    assert {(r["g"], r["v"]): r["rank"] for r in got} == {
        (g, v): (500 if g == "hot" else 3) - v for g, v in data
    }


def two_cliques(spark):
    edges = []
    for tag in "ab":
        names = [f"{tag}{i}" for i in range(5)]
        edges += [(x, y, 5) for i, x in enumerate(names) for y in names[i + 1 :]]
    return spark.createDataFrame(edges + [("a0", "b0", 1)], "a string, b string, weight int")


def test_communities_split_cliques_and_repeat(spark):
    edges = two_cliques(spark)
    first = sorted(tuple(r) for r in detect_communities(edges).collect())
    groups = {}
    for node, community in first:
        groups.setdefault(community, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [[f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]]
    assert first == sorted(tuple(r) for r in detect_communities(edges).collect())
    labels = spark.createDataFrame(first, "concept string, community string")
    assert modularity(edges, labels) > 0.4


TEXTS = {
    "doc1": ["Calibration of the logistic regression prediction rule was assessed, calibration slope and calibration.",
             "The logistic regression prediction rule, good calibration, validation cohort."],
    "doc2": ["Calibration of the survival curve rule, calibration slope, calibration curve.",
             "The survival curve rule, adequate calibration, validation cohort."],
}


@pytest.fixture(scope="module")
def corpus(spark):
    data = [
        (f"{d}-c{i}", d, t, "text", ["s"], [], 1, None, None, None)
        for d, ts in TEXTS.items() for i, t in enumerate(ts, 1)
    ]
    return spark.createDataFrame(data, CHUNK)


def test_build_and_search_small_corpus(spark, corpus):
    g = GraphSettings(min_concept_freq=1, min_edge_weight=1, seed_sim_min=0.2)
    path = scratch_path(spark, "graph")
    assert open_graph(spark, path) is None
    graph = build_graph(corpus, path, g)
    assert open_graph(spark, path) is not None
    m = graph.meta
    assert m["n_chunks"] == 4 and m["n_concepts_kept"] == graph.table("concepts").count() > 3
    weights = graph.table("edges").collect()
    assert all(r["weight"] >= 1 and r["a"] < r["b"] for r in weights)
    batch = QueryBatch.bounded(
        spark.createDataFrame([("q", "calibration slope"), ("x", "zzz qqq")], "query_id string, question string"), 2
    )
    for fusion in ("accum", "rrf", "hybrid"):
        res = graph_search(graph, batch, GraphSettings(min_concept_freq=1, min_edge_weight=1, seed_sim_min=0.2, fusion=fusion),
                           top_k=4, chunks=corpus)
        found = [r["chunk_id"] for r in res.ranked.filter("query_id = 'q'").orderBy("rank").collect()]
        assert {c.split("-")[0] for c in found} == {"doc1", "doc2"}
    facts = {r["query_id"]: r for r in res.facts.collect()}
    assert facts["q"]["n_active_concepts"] <= g.budget_concepts and facts["x"]["n_seeds"] >= 1
    again = build_graph(corpus, scratch_path(spark, "graph"), g)
    key = lambda t: sorted(tuple(r) for r in t.table("concepts").select("concept", "community").collect())
    assert key(again) == key(graph)


def test_graph_hits_carry_payload_and_facts(spark, corpus):
    g = GraphSettings(min_concept_freq=1, min_edge_weight=1, seed_sim_min=0.2)
    graph = build_graph(corpus, scratch_path(spark, "graph"), g)
    batch = QueryBatch.bounded(spark.createDataFrame([("q", "calibration slope")], "query_id string, question string"), 1)
    whole = graph_search(graph, batch, g, top_k=9).ranked.orderBy("rank").collect()
    gone = whole[0]["chunk_id"]
    index = build_index(corpus.filter(F.col("chunk_id") != gone), scratch_path(spark, "index"))
    rows = graph_hits(graph, batch, index, g, top_k=len(whole) - 1).orderBy("rank").collect()
    assert [r["chunk"]["chunk_id"] for r in rows] == [r["chunk_id"] for r in whole[1:]]
    assert [r["rank"] for r in rows] == list(range(1, len(whole)))
    assert rows[0]["graph"]["n_candidates"] >= len(rows) and all(r["graph"] is None for r in rows[1:])
    assert rows[0]["citation"]["doc_id"] == rows[0]["chunk"]["doc_id"] and rows[0]["chunk"]["text"]


def test_missing_graph_gives_empty(spark):
    batch = QueryBatch.bounded(spark.createDataFrame([("q", "a")], "query_id string, question string"), 1)
    assert graph_search(None, batch).ranked.count() == 0


def test_full_queries_are_decided_by_bounds_or_counted(spark):
    """Largest concept decides one query, the sum another; two need a count, of which one has shared chunks."""
    places = [("a", f"k{i}") for i in range(6)] + [(c, f"{c}{i}") for c in "bcd" for i in range(2)] + [("e", "b0"), ("e", "b1"), ("b", "b1")]
    inc = spark.createDataFrame(places, "concept string, chunk_id string")
    seen = [("one", "a"), ("two", "b"), ("two", "c"), ("many", "b"), ("many", "c"), ("many", "d"), ("shared", "b"), ("shared", "c"), ("shared", "e")]
    visited = spark.createDataFrame(seen, "query_id string, concept string")
    assert sorted(r[0] for r in X._full(visited, inc, 5).collect()) == ["many", "one"]
    whole = visited.join(inc, "concept").groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n"))
    for budget in range(1, 8):
        want = sorted(r[0] for r in whole.filter(F.col("n") >= budget).collect())
        assert sorted(r[0] for r in X._full(visited, inc, budget).collect()) == want


def test_cooccurrence_shuffles_rows_and_pairs_once(spark):
    data = [(c, len(c), f"k{k}", None if k == 3 else f"d{k % 2}") for k in range(5) for c in ("x", "y", "zz")[: 2 + k % 2]]
    pairs = C.cooccurrence(spark.createDataFrame(data, "concept string, freq int, chunk_id string, doc_id string"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, pairs.collect())) == [("x", "y", 5, 2), ("x", "zz", 2, 1), ("y", "zz", 2, 1)]
