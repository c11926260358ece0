import os
import random

import pytest
from pyspark.sql import functions as F

from quarrylight import session
from quarrylight.llm import quality

SCHEMA = "doc_id long, text string, source string, lang string, kept string, quality_score int"


def corpus(n=240):
    rng = random.Random(1)
    good = ["river", "stone", "meadow", "light", "winter", "garden", "paper", "music"]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(good) for _ in range(rng.randrange(10, 60))]
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        docs.append((i, text, f"s{i % 3}", "en", "x", 1))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    odd = [(900, None, None, None, None, None), (901, "", "s0", "en", "x", 1), (None, docs[1][1], "s1", "en", "x", 1), (1, *docs[1][1:]), (902, "stone light " * 50_000, "s2", "en", "x", 1)]
    frame = spark.createDataFrame(docs + odd, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (4, None, 0), (5000, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, frame, marks


def test_scores_tell_the_classes_apart(fitted):
    docs, frame, marks = fitted
    scored = quality.score(frame, marks)
    assert scored.columns == ["doc_id", "text", "source", "lang", "quality_score", "text_score", "meta_score", "kept"]
    rows = scored.collect()
    assert len(rows) == frame.count()
    assert all(0 <= r[c] <= 1 for r in rows for c in ("quality_score", "text_score", "meta_score"))
    right = [r["kept"] == (r["doc_id"] % 4 != 0) for r in rows if r["doc_id"] is not None and r["doc_id"] < 240]
    assert sum(right) >= 0.98 * len(right)
    assert len({r["quality_score"] for r in rows if r["doc_id"] in (1, None)}) == 1


def test_keep_good_keeps_columns(fitted):
    _, frame, marks = fitted
    kept = quality.keep_good(frame, marks)
    assert kept.columns == frame.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 4 not in ids and {1, 2, 3, 902} <= ids


@pytest.mark.parametrize("labels, want", [([], 1.0), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0)])
def test_without_both_classes_the_rate_is_the_score(spark, labels, want):
    docs = spark.createDataFrame([(1, "a", "s", "en", "", 0), (2, "b", "s", "en", "", 0)], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r["quality_score"] for r in quality.score(docs, marks).collect()} == {want}


def test_empty_table(spark, fitted):
    _, frame, marks = fitted
    assert quality.score(frame.where("false"), marks).count() == 0


@pytest.mark.parametrize("folder, least", [("sf0.01", 0.9), ("sf0.1", 0.985)])
def test_held_out_accuracy_on_the_tables(spark, folder, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.co_train(docs, labels.where("doc_id % 5 <> 0"))
    scored = model.score(quality.with_views(docs)).join(labels.where("doc_id % 5 = 0"), "doc_id")
    rows = scored.select("quality", "__q_score").collect()
    assert sum((r[1] >= 0.5) == (r[0] == 1) for r in rows) >= least * len(rows)
    good = [r[1] >= 0.5 for r in rows if r[0] == 1]
    assert sum(good) >= least * len(good)


def test_tokens_of_distinct_words_are_those_of_the_text(spark):
    texts = ["", "  ", " Ab3 ab  AB!! \n ab 12\tab ", "\u0130stanbul \u03a3\u03a3 \u03b1\u03a3 caf\u00e9\u00a0x \u4e2d\u6587 a\u0301 \u00bd \U0001f600 A a"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = F.concat(
        F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+|\\p{N}+|[^\\p{L}\\p{N}\\s]+"), F.lit(0)),
        F.expr(r"""transform(split(regexp_replace(regexp_replace(regexp_replace(text, r'\p{Lu}+', 'A'), r'[\p{L}&&[^A]]+', 'a'), r'\p{N}+', '0'), r'\s+'),
        s -> concat('shape ', substring(s, 1, 12)))"""),
    )
    rows = frame.select(whole.alias("want"), quality._text_tokens(F.array_distinct(F.split("text", "\\s+"))).alias("got")).collect()
    assert all(set(r["got"]) == set(r["want"]) for r in rows)
    share = lambda p: F.length(F.regexp_replace("text", f"[^{p}]+", "")) / F.greatest(F.length("text"), F.lit(1))
    wanted = [share(p) for p in ("\\p{Lu}", "\\p{N}", "\\p{L}", "\\s")]
    words = F.split("text", "\\s+")
    figures = quality._page_figures(F.col("text"), words, F.array_distinct(words), F.regexp_replace("text", "\\p{L}+", ""))
    for r in frame.select(*wanted, *(figures[n] for n in ("upper", "digits", "letters", "space"))).collect():
        assert tuple(r)[:4] == tuple(r)[4:]


def test_views_are_made_once(fitted, monkeypatch):
    _, frame, marks = fitted
    made = []
    whole = quality.with_views
    monkeypatch.setattr(quality, "with_views", lambda *a: made.append(1) or whole(*a))
    rows = quality.score(frame, marks, columns=["doc_id"])
    assert rows.columns == ["doc_id", "quality_score", "text_score", "meta_score", "kept"]
    assert rows.count() == frame.count() and len(made) == 1
    assert quality.keep_good(frame, marks).count() <= frame.count() and len(made) == 2


def scratch_folders(spark):
    own = f"{session.shared_dir(spark).removeprefix('file:')}/quarrylight/{spark.sparkContext.applicationId}"
    return set(os.listdir(own)) if os.path.isdir(own) else set()


def test_keep_good_leaves_its_rows_and_no_views(spark, fitted):
    _, frame, marks = fitted
    before = scratch_folders(spark)
    kept = quality.keep_good(frame, marks)
    left = [name.rsplit("-", 1)[0] for name in scratch_folders(spark) - before]
    assert "views" not in left and left.count("kept-pages") == 1
    assert 0 < kept.count() < frame.count()
