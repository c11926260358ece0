from collections import Counter

import pytest

import corpus_pipeline as P
from quarrylight.llm import mixing, quality, token_shards
from tests.llm.test_decontaminate import naive as naive_leaks
from tests.llm.test_simhash import naive_fingerprint, naive_groups


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def stage(name):
    return dict(P.STAGES)[name]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "source mix", "training order"]


def test_classifier_keeps_clean_documents(spark, docs, small):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = stage("quality classifier")(spark, docs, small)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in ids for d in good) >= 0.98 * len(good)


def test_one_document_of_each_group_stays(spark, docs, small):
    rows = {r["doc_id"]: naive_fingerprint(r["text"]) for r in docs.collect()}
    group = naive_groups(sorted(set(rows.values())))
    want = {}
    for d in sorted(rows):
        want.setdefault(group[rows[d]], d)
    kept = stage("simhash near-dedup")(spark, docs, small)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want.values())


def test_leaks_go(spark, docs, small):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    bad = {d for d, *_ in naive_leaks(rows, items)}
    kept = stage("benchmark decontamination")(spark, docs, small)
    assert kept.columns == docs.columns
    assert bad and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in rows if d not in bad)


def test_mix_repeats_documents(spark, docs, small):
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs).collect()}
    got = stage("source mix")(spark, docs, small)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({d: n for d, n in plan.items() if n})


def test_run_applies_all_stages(spark, docs, small):
    rows = P.run(spark, small).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    held = {d for r in rows for d in r["doc_ids"]}
    assert held and held < {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_odd_and_empty_tables(spark, small, tmp_path, name):
    rows = [
        (1, "plain words in a short text.", "en", "src0", 3, "x"), (1, "plain words in a short text.", "en", "src0", 3, "x"), (None, None, None, None, None, None),
        (2, "", "en", None, 0, ""), (3, "word " * 50_000, "de", "src1", None, "y"), (4, None, "fr", "src0", 1, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rate string"
    for n, data in enumerate((rows, [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{n}")
        frame = spark.read.parquet(f"{tmp_path}/{n}")
        out = stage(name)(spark, frame, small)
        if name != "training order":
            assert out.columns == frame.columns
        count = out.count()
        assert count == 0 if not data else count > 0
    assert quality.KEEP == 0.5 and token_shards.WIDTH == 2
