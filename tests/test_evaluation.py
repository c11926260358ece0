import json
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.contracts import CHUNK
from quarrylight.evaluation import experiments as X
from quarrylight.evaluation import metrics as M
from quarrylight.evaluation import probes as P
from quarrylight.plans.evaluation import decide, run_eval, write_report
from quarrylight.plans.experiment import run_experiments, score_external
from quarrylight.plans.index import build_index, lazy_index
from quarrylight.recipe import EvalSettings
from quarrylight.session import scratch_path

PROBE = "id string, scope string, gold_chunk_ids array<string>"
FOUND = "id string, rank int, chunk_id string"


def test_probe_score(spark):
    probes = spark.createDataFrame([("p", "global", ["x", "y", "z"]), ("e", "local", [])], PROBE)
    found = spark.createDataFrame([("p", 1, "q"), ("p", 2, "y"), ("p", 3, "x"), ("e", 1, "q")], FOUND)
    got = {r["id"]: (round(r["recall"], 4), r["hit"], r["rr"]) for r in M.probe_scores(probes, found).collect()}
    assert got == {"p": (0.6667, 1.0, 0.5), "e": (0.0, 0.0, 0.0)}


def test_probe_class(spark):
    probes = spark.createDataFrame(
        [("a", "global", ["n1", "s1"]), ("b", "global", ["n1"]), ("c", "global", ["n1", "u1"]), ("d", "local", ["s1"])], PROBE
    )
    docs = spark.createDataFrame([("n1", "N"), ("s1", "S"), ("u1", "U")], "chunk_id string, doc_id string")
    src = spark.createDataFrame([("N", "native"), ("S", "scan")], "doc_id string, doc_class string")
    got = {r["id"]: (r["doc_class"], r["n_scan_gold"]) for r in M.probe_classes(probes, docs, src).collect()}
    assert got == {"a": ("scan", 1), "b": ("native", 0), "c": ("unknown", 0), "d": ("scan", 1)}


@pytest.mark.parametrize(
    "ln,lr,gn,gr,decision",
    [
        (0, None, 0, None, "INSUFFICIENT_DATA"), (5, 0.5, 5, 0.9, "TUNE_RETRIEVAL_FIRST"),
        (5, 0.9, 0, None, "HYBRID_SUFFICIENT"), (5, 0.9, 5, 0.7, "HYBRID_SUFFICIENT"),
        (5, 0.9, 5, 0.4, "CONSIDER_GRAPH_OR_ROUTING"), (5, 0.8, 5, 0.6, "MONITOR"),
    ],
)
def test_decision(spark, ln, lr, gn, gr, decision):
    cells = spark.createDataFrame(
        [("local", "all", ln, lr), ("global", "all", gn, gr)], "scope string, doc_class string, n long, recall_at_k double"
    )
    assert decide(cells).first()["decision"] == decision


def test_stratum_note(spark):
    rows = [("local", "all", 9, 0.9), ("global", "all", 9, 0.5), ("global", "native", 3, 0.8), ("global", "scan", 3, 0.5)]
    cells = spark.createDataFrame(rows, "scope string, doc_class string, n long, recall_at_k double")
    assert decide(cells).first()["stratum_note"] is True
    few = cells.withColumn("n", F.when(F.col("doc_class") == "scan", 2).otherwise(F.col("n")))
    assert decide(few).first()["stratum_note"] is False


def test_round_robin_equals_nested_loops(spark):
    rnd = random.Random(2)
    for n in (1, 4, 9, 30):
        docs = {f"d{i}": sorted(f"d{i}-c{j}" for j in rnd.sample(range(30), rnd.randint(1, 6))) for i in range(7)}
        df = spark.createDataFrame([(c, d) for d, cs in docs.items() for c in cs], "chunk_id string, doc_id string").repartition(3)
        expected, depth = [], 0
        while len(expected) < n and any(depth < len(cs) for cs in docs.values()):
            for d in sorted(docs):
                if depth < len(docs[d]) and len(expected) < n:
                    expected.append(docs[d][depth])
            depth += 1
        assert sorted(r["chunk_id"] for r in P.round_robin(df, n).collect()) == sorted(expected)


TEXTS = {
    "d1": ["imatinib trial dosing schedule", "survival curve estimation details"],
    "d2": ["imatinib response tumour markers", "unrelated pathology archive scanning"],
}


@pytest.fixture(scope="module")
def index(spark):
    data = [
        (f"{d}-c{i}", d, t, "text", [f"S{i}"], [], 1, None, None, None) for d, ts in TEXTS.items() for i, t in enumerate(ts, 1)
    ]
    return build_index(spark.createDataFrame(data, CHUNK), scratch_path(spark, "test"))


def test_generated_probes(spark, index):
    got = {r["id"]: (r["scope"], r["gold_chunk_ids"]) for r in P.generate_probes(index, 30, 10).collect()}
    assert got["global::imatinib"] == ("global", ["d1-c1", "d2-c1"])
    assert sum(1 for s, _ in got.values() if s == "local") == 4
    assert P.global_probes(index, 30, 1).count() == 0
    hard = {r["gold_chunk_ids"][0]: r["question"] for r in P.hard_local_probes(index).collect()}
    assert hard["d1-c1"] == "imatinib trial"


def test_eval_run_and_report(spark, index, tmp_path):
    src = spark.createDataFrame([("d1", "native"), ("d2", "scan")], "doc_id string, doc_class string")
    run = run_eval(index, src)
    cells = {(r["scope"], r["doc_class"]): r for r in run.cells.collect()}
    assert cells[("local", "all")]["n"] == 4 and cells[("global", "scan")]["n"] >= 1 and cells[("global", "native")]["n"] == 0
    assert cells[("global", "native")]["recall_at_k"] is None
    out = write_report(run, index, src, str(tmp_path), EvalSettings())
    assert out["decision"] == "HYBRID_SUFFICIENT" and (out["n_docs_native"], out["n_docs_scan"]) == (1, 1)
    assert json.loads((tmp_path / "eval.json").read_text())["n_probes"] == len(out["per_probe"])
    assert "Decision: HYBRID_SUFFICIENT" in (tmp_path / "eval.md").read_text()


def test_experiments(spark, index):
    feats = spark.createDataFrame(
        [("d1", "native", 1999, 50, True, False)],
        "doc_id string, source string, year int, n_chunks int, has_tables boolean, has_formulas boolean",
    )
    out = run_experiments(index, feats)
    assert out["by_kind"].first()["n_total"] == 4
    levels = {(r["modifier"], r["level"]): r["n"] for r in out["modifiers"].collect()}
    assert levels[("era", "<2010")] == 2 and levels[("doc_size", "small(<40c)")] == 2 and levels[("has_tables", "True")] == 2
    assert {r["k"] for r in out["difficulty"].collect()} == {1, 3, 5, 10}
    assert {r["cell"] for r in out["factorial"].collect()} == set(X.CELLS)


def test_difficulty_of_one_probe_has_zero_deviation(spark):
    df = spark.createDataFrame([("p", 2)], "id string, rank int")
    got = {r["k"]: (r["recall_at_k"], r["sd_at_k"], r["mrr"]) for r in X.local_difficulty(df).collect()}
    assert got[1] == (0.0, 0.0, 0.5) and got[3] == (1.0, 0.0, 0.5)


def test_external_gold(spark, index):
    gold = spark.createDataFrame(
        [("1", "local", "imatinib trial dosing", ["d1-c1"], None), ("2", "global", "imatinib", ["d1-c1", "zz"], True),
         ("3", "global", "x", ["d1-c1"], False), ("4", "local", "y", [], True)],
        "id string, scope string, question string, gold_chunk_ids array<string>, answerable boolean",
    )
    got = {r["scope"]: (r["n"], r["recall"], r["hit_rate"]) for r in score_external(index, gold, top_k=4).collect()}
    assert got == {"local": (1, 1.0, 1.0), "global": (1, 0.5, 1.0), "overall": (2, 0.75, 1.0)}
    draw = [score_external(index, gold, top_k=4, sample=1, seed=3).filter("scope = 'overall'").first()["n"] for _ in range(2)]
    assert draw == [1, 1]


def test_verdict(spark):
    def of(graph, multi):
        means = spark.createDataFrame([("graph", graph), ("multi", multi), ("hybrid", 0.9)], "arm string, mean_recall double")
        return X.verdict(means).first()["verdict"]

    assert of(0.5, 0.4) == "graph BEATS multi-query (0.5000 vs 0.4000, +0.1000)"
    assert of(0.4, 0.4) == "graph TIES multi-query (0.4000 vs 0.4000)"
    assert of(None, 0.25) == "graph LOSES to multi-query (0.0000 vs 0.2500, -0.2500)"


def test_gold_is_looked_up_by_the_rarest_word(spark):
    from catalog.evaluate import covering_chunks
    from test_search import chunk_rows

    texts = ["stone the old mill", "the old stone", "mill the old river stone", "river the old", "THE OLD Stone mill"]
    index = lazy_index(chunk_rows(spark, texts), scratch_path(spark, "gold"))
    asked = [("a", "the old stone"), ("b", "stone the mill"), ("c", "the old"), ("d", "the old dragon"), ("e", "river the old"), (None, "the old stone")]
    found = covering_chunks(index, spark.createDataFrame(asked, "id string, opening string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    want = [
        (q, f"c{i}") for q, o in asked for i, t in enumerate(texts, 1)
        if q and len(o.split()) >= 3 and set(o.split()) <= set(t.lower().split())
    ]
    assert sorted(tuple(r) for r in found.collect()) == want
    # Chunks are held against all words before anything is shuffled.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("forall") > plan.index("Exchange hashpartitioning")
    assert index.built == {"chunks", "terms", "term_stats"}


def test_local_probes_count_no_other_chunks(spark):
    from test_search import chunk_rows

    index = lazy_index(chunk_rows(spark, [f"stone mill river gate w{i}" for i in range(9)]), scratch_path(spark, "local"))
    assert P.local_probes(index, 5).count() == 5 and index.built == {"chunks"}
