import base64
import os
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarrylight.llm import token_shards as T

SCHEMA = "doc_id long, text string, slot int, sequence string"
pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file")


def encoding():
    with open(T.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_slots_are_a_keyed_bijection(n):
    index = np.arange(n)
    slot = T.slots(index, n)
    assert sorted(slot.tolist()) == list(range(n))
    assert (T.sequences_at(slot, n) == index).all()
    if n > 100:
        assert (slot != T.slots(index, n, seed=30)).mean() > 0.9
        assert abs(np.corrcoef(index, slot)[0, 1]) < 0.2


def test_shards_hold_all_tokens_in_slot_order(spark, tmp_path):
    texts = ["Hello world.", None, "", "naïve Übung " * 300, "a\nb\n\nc", "x" * 5000, "Hello world.", "\n", "日本語 text"]
    docs = spark.createDataFrame([(i if i != 4 else None, t, 0, "c") for i, t in enumerate(texts)], SCHEMA).coalesce(1)
    path = f"{tmp_path}/out"
    pairs = T.write_shards(docs, path, length=16, per_shard=8, stored=False).collect()
    at = T.meta(spark, path)
    rows = {r["slot"]: r for r in T.read_shards(spark, path).collect()}
    assert sorted(rows) == list(range(at["total"]))
    order = [rows[s]["ids"] for s in T.slots(np.arange(at["total"]), at["total"]).tolist()]
    flat = [i for ids in order for i in ids]
    ours, one = encoding(), []
    stored = []
    for i in flat:
        if i == T.END:
            stored.append(ours.decode(one))
            one = []
        else:
            one.append(i)
    assert stored[: len(texts)] == [t or "" for t in texts] and not any(stored[len(texts) :])
    for r in rows.values():
        assert r["shard"] == r["slot"] // 8 and r["offset"] == r["slot"] % 8 * 33
    files = sorted((tmp_path / "out" / "shards").rglob("part-*"))
    assert len(files) == -(-at["total"] // 8) and all(f.stat().st_size % 33 == 0 for f in files)
    assert {p["slot"] for p in pairs} == set(rows)
    assert {p["slot"] for p in pairs} == set(T.slots(np.array([p["sequence"] for p in pairs]), at["total"]).tolist())
    late = T.read_shards(spark, path, from_slot=13)
    assert sorted(r["slot"] for r in late.collect()) == list(range(13, at["total"]))


def test_training_order_of_several_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = T.training_order(docs, length=64, per_shard=100).collect()
    again = T.training_order(docs, length=64, per_shard=100).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    ours = encoding()
    assert sum(r["n_tokens"] for r in rows) == sum(len(ours.encode_ordinary(r["text"] or "")) for r in docs.collect())
    assert {d for r in rows for d in r["doc_ids"]} == {r[0] for r in docs.select("doc_id").collect()}


def test_pieces_do_not_change_tokens(monkeypatch):
    text = "Some words, 12 numbers and  double spaces\n\nnew lines don't matter é ü " * 40
    ours = encoding()
    whole = ours.encode_ordinary(text)
    monkeypatch.setattr(T, "PIECE", 50)
    assert [i for p in T.pieces(text) for i in ours.encode_ordinary(p)] == whole


def test_empty_table(spark):
    assert T.training_order(spark.createDataFrame([], SCHEMA), stored=False).count() == 0
    one = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert [r["n_tokens"] for r in T.training_order(one, stored=False).collect()] == [0]


def test_distinct_words_give_the_tokens_of_whole_texts(monkeypatch):
    rng = random.Random(4)
    signs = [*"ab  \n\t 　  \x1c\x85é üж日本'sTt12!?«", "'ll", " the ", "\U0001f600"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["", None, " ", "x" * 600, " lead", "trail "]
    ours = encoding()
    want = [[*ours.encode_ordinary(t or ""), T.END] for t in texts]
    with open(T.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    vocabulary = T.Vocabulary(ours, ranks)
    monkeypatch.setattr(T, "PIECE", 300)
    monkeypatch.setattr(T, "BLOCK", 5000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    blocks = [vocabulary.ids(b.column(1)) for b in T._blocks([batch])]
    assert len(blocks) > 3
    assert np.concatenate([n for n, _ in blocks]).tolist() == [len(w) for w in want]
    assert np.concatenate([ids for _, ids in blocks]).tolist() == [i for w in want for i in w]
    assert vocabulary.ids(pa.array([], pa.string()))[0].tolist() == []


def test_a_word_is_encoded_once_however_often_it_stands(monkeypatch):
    ours, given = encoding(), []

    class Counting:
        def encode_to_numpy(self, text, **options):
            given.append(len(text))
            return ours.encode_to_numpy(text, **options)

    with open(T.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes, _ = T.Vocabulary(Counting(), ranks).ids(pa.array(["some frequent words " * 500] * 100))
    assert sum(given) < 1000 and len(set(sizes.tolist())) == 1
