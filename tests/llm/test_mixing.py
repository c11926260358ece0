from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import mixing


def naive_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        rise = (total - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * sizes[s] <= rise * weight[s]}
        if not over:
            return out | {s: rise * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 10, "c": 1000, None: 50}, {"x": 5}, {"a": 0, "b": 0}, {"a": 10, "b": 10, "c": 10, "d": 10, "e": 4}, {"": 7, "é": 3, "z": 900}],
)
def test_targets_equal_repeated_resharing(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, n long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame, "source", "n").collect()}
    assert got == pytest.approx(naive_targets(sizes))


@pytest.mark.parametrize("text, n", [(None, 0), ("", 0), (" \t\n", 0), ("a", 1), (" a  b\x0bc ", 3), ("a b", 1), ("x\n", 1), ("ü ß", 2)])
def test_word_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.word_count(F.col("t"))).first()[0] == n


def odd_docs(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 9 else None, i) for i in range(600)]
    rows += [(None, "no id", "s0", 1), (3, None, "s1", 2), (3, "", "empty", 3), (4, "again again", "s2", 4), (4, "again again", "s2", 4)]
    rows += [(10_000, "long " * 50_000, "s3", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")


def test_plan_and_mix_agree(spark):
    docs = odd_docs(spark)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == docs.count()
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in plan:
        assert 0 <= r["copies"] <= 2
        by[r["source"]][0] += r["size"] * r["copies"]
        by[r["source"]][1] = r["target"]
        by[r["source"]][2] = max(by[r["source"]][2], r["size"])
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest + 0.05 * target
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {(r["doc_id"], r["source"]): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    want = defaultdict(int)
    for r in plan:
        want[(r["doc_id"], r["source"])] += r["copies"]
    assert got == {k: v for k, v in want.items() if v}
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, plan))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_plan(docs).count() == 0
    assert mixing.mix(docs).count() == 0
