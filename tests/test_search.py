import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.contracts import CHUNK
from quarrylight.operators import blocks, dense, lists, sparse
from quarrylight.operators.embed import get_embedder
from quarrylight.operators.fusion import reciprocal_rank_fusion
from quarrylight.functions import counts, text as tx
from quarrylight.functions.counts import SETTLED, counted_chunks
from quarrylight.plans.index import build_index, lazy_index
from quarrylight.plans.multi import multi_query_search, subqueries
from quarrylight.plans.search import QueryBatch, hybrid_search, pruning_report, search_hits, sparse_arm
from quarrylight.recipe import SearchSettings
from quarrylight.session import scratch_path


def chunk_rows(spark, texts, kind="text"):
    data = [
        (f"c{i}", f"d{i % 3}", t, kind, ["s"], [], 1, None if kind == "text" else f"d{i % 3}-t{i}", None, None)
        for i, t in enumerate(texts, 1)
    ]
    return spark.createDataFrame(data, CHUNK)


def queries(spark, *texts):
    frame = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, question string")
    return QueryBatch.bounded(frame, len(texts))


@pytest.fixture(scope="module")
def stones(spark):
    texts = ["granite resists frost damage", "granite quarrying needs water", "limestone dissolves slowly"]
    return build_index(chunk_rows(spark, texts), scratch_path(spark, "test"))


def test_rrf_golden(spark):
    lists = [("q", 0, r, c) for r, c in enumerate("abc", 1)] + [("q", 1, r, c) for r, c in enumerate("cad", 1)]
    df = spark.createDataFrame(lists, "query_id string, list_no int, rank int, chunk_id string")
    got = [(r["chunk_id"], round(r["score"], 6)) for r in reciprocal_rank_fusion(df).orderBy("rank").collect()]
    assert got == [("a", 0.032522), ("c", 0.032266), ("b", 0.016129), ("d", 0.015873)]


def test_rrf_order_equals_stable_sort(spark):
    rnd = random.Random(7)
    data, expected = [], {}
    for case in range(200):
        lists = [rnd.sample("abcdefgh", rnd.randint(1, 8)) for _ in range(rnd.randint(1, 4))]
        scores: dict[str, float] = {}
        for no, items in enumerate(lists):
            for rank, item in enumerate(items, 1):
                scores[item] = scores.get(item, 0.0) + 1.0 / (60 + rank)
                data.append((str(case), no, rank, item))
        expected[str(case)] = sorted(scores, key=lambda i: -scores[i])
    df = spark.createDataFrame(data, "query_id string, list_no int, rank int, chunk_id string").repartition(7)
    got: dict[str, list[str]] = {}
    for r in reciprocal_rank_fusion(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == expected


def test_bm25_golden(spark, stones):
    batch = queries(spark, "granite quarrying")
    scores = sparse.bm25_scores(
        sparse.query_terms(batch.frame), stones.postings, stones.table("term_stats"), 3,
        stones.stats["n_tokens"] / 3,
    )
    got = {r["chunk_id"]: r["score"] for r in scores.collect()}
    assert got == {"c2": pytest.approx(1.398811, abs=2e-6), "c1": pytest.approx(0.453151, abs=2e-6)}


@pytest.mark.parametrize("limit", [4096, 2])
def test_dense_batch_and_block_forms_agree(spark, limit):
    rng = np.random.default_rng(1)
    items = rng.normal(size=(300, 8)).round(1)
    items[::3] = items[0]  # a third of all vectors are copies
    asks = rng.normal(size=(9, 8)).round(1)
    vecs = spark.createDataFrame(
        [(f"i{i:03d}", [float(x) for x in v]) for i, v in enumerate(items)], "chunk_id string, vector array<float>"
    ).repartition(5)
    qs = spark.createDataFrame(
        [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(asks)], "query_id string, vector array<float>"
    )
    got = {}
    for r in dense.dense_topk(vecs, qs, 7, max_batch=limit).collect():
        got[(r["query_id"], r["rank"])] = (r["chunk_id"], r["score"])
    f32 = lambda m: m.astype(np.float32).astype(np.float64)
    sims = np.round(f32(asks) @ f32(items).T, 6)
    for q in range(len(asks)):
        order = sorted(range(len(items)), key=lambda i: (-sims[q, i], f"i{i:03d}"))[:7]
        for rank, i in enumerate(order, 1):
            name, score = got[(f"q{q}", rank)]
            assert name == f"i{i:03d}" and score == pytest.approx(sims[q, i], abs=1e-6)


def test_dense_moments(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, vector array<float>")
    qs = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    r = dense.dense_moments(vecs, qs).first()
    assert (r["mean"], r["sd"]) == (0.5, 0.5)
    many = spark.createDataFrame([(f"q{i}", [float(i), 1.0]) for i in range(9)], "query_id string, vector array<float>")
    whole = {r["query_id"]: (r["mean"], r["sd"]) for r in dense.dense_moments(vecs, many).collect()}
    parts = {r["query_id"]: (r["mean"], r["sd"]) for r in dense.dense_moments(vecs, many, max_batch=2).collect()}
    assert len(whole) == 9 and parts == whole


def test_hybrid_search_and_hits(spark, stones):
    batch = queries(spark, "granite quarrying water", "limestone")
    top = {r["query_id"]: r["chunk_id"] for r in hybrid_search(stones, batch, top_k=1).collect()}
    assert top == {"q0": "c2", "q1": "c3"}
    hits = search_hits(stones, batch, top_k=2, route=True).orderBy("query_id", "rank").collect()
    assert hits[0]["route"]["returned_top_k"] == 2 and hits[1]["route"] is None
    assert hits[0]["citation"]["chunk_id"] == "c2" and hits[0]["chunk"]["page"] == 1
    plain = search_hits(stones, batch, SearchSettings(), top_k=2).select("query_id", "rank", "citation.chunk_id")
    off = search_hits(stones, batch, top_k=2, route=False).select("query_id", "rank", "citation.chunk_id")
    assert sorted(plain.collect()) == sorted(off.collect())


def test_zero_width_gives_nothing_but_multi_uses_default(spark, stones):
    batch = queries(spark, "granite")
    assert hybrid_search(stones, batch, top_k=0).count() == 0
    assert multi_query_search(stones, batch, top_k=0).count() > 0


def test_artifact_hit_keeps_its_id(spark):
    ix = build_index(chunk_rows(spark, ["Dose | Weight"], kind="table"), scratch_path(spark, "test"))
    hit = search_hits(ix, queries(spark, "dose weight"), top_k=3).first()
    assert hit["citation"]["artifact_id"] == "d1-t1" and hit["chunk"]["kind"] == "table"


def test_rerank_token_overlap_and_missing_model(spark, stones):
    batch = queries(spark, "frost damage granite")
    again = hybrid_search(stones, batch, SearchSettings(rerank_enabled=True), top_k=3).orderBy("rank").collect()
    assert again[0]["chunk_id"] == "c1" and again[0]["score"] == 1.0
    same = hybrid_search(stones, batch, SearchSettings(rerank_model="absent"), top_k=3, rerank=True)
    assert sorted(same.collect()) == sorted(hybrid_search(stones, batch, top_k=3).collect())


def test_subqueries_strip_scaffold(spark):
    batch = queries(spark, "compare and summarize across the studies: shrinkage overfitting shrinkage")
    got = [r["question"] for r in subqueries(batch.frame, 4).orderBy("list_no").collect()]
    assert got[1:] == ["shrinkage", "overfitting"]
    one = subqueries(batch.frame, 1).count()
    assert one == 2


def test_given_subqueries_replace_automatic(spark, stones):
    batch = queries(spark, "granite")
    extra = spark.createDataFrame(
        [("q0", 0, "limestone"), ("q0", 1, "limestone dissolves")], "query_id string, pos int, question string"
    )
    found = multi_query_search(stones, batch, top_k=3, extra=extra).filter("rank = 1").first()
    assert found["chunk_id"] == "c3"


def test_embedder_unit_and_empty():
    m = get_embedder().encode(["granite stone granite", ""])
    assert np.linalg.norm(m[0]) == pytest.approx(1, abs=1e-6) and not m[1].any()
    assert get_embedder().encode([]).shape == (0, 384)


def test_skewed_term_and_partition_counts_do_not_change_results(spark):
    texts = [f"granite common word{i % 5} tail{i}" for i in range(200)] + ["rare basalt"]
    batch = queries(spark, "common granite", "basalt rare", "word3 granite")
    seen = []
    for parts in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        ix = build_index(chunk_rows(spark, texts).repartition(int(parts)), scratch_path(spark, "test"))
        seen.append(sorted(tuple(r) for r in hybrid_search(ix, batch, top_k=10).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and len(seen[0]) == 30


def test_empty_postings_fall_back_to_dense(spark):
    ix = build_index(chunk_rows(spark, ["a b", "? !"]), scratch_path(spark, "test"))
    assert hybrid_search(ix, queries(spark, "granite"), top_k=5).count() == 2


def zipf_index(spark, n=3000, name="zipf"):
    """Chunks of very unevenly frequent words, a few of them rare, with copies."""
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    shares = [1 / (i + 1) for i in range(4000)]
    texts = ["the " * rnd.randint(1, 3) + " ".join(rnd.choices(vocab, shares, k=rnd.randint(3, 30))) for _ in range(n)]
    texts += [texts[0]] * 200 + ["", "the"]
    return build_index(chunk_rows(spark, texts).repartition(5), scratch_path(spark, name)), texts


@pytest.fixture(scope="module")
def zipf(spark):
    return zipf_index(spark)


@pytest.mark.parametrize("top", [1, 10, 200])
def test_pruned_topk_equals_all_scores(spark, zipf, top):
    index, texts = zipf
    rnd = random.Random(5)
    asked = [" ".join(rnd.sample(texts[rnd.randrange(3000)].split(), 4)) for _ in range(15)]
    batch = queries(spark, *asked, "the", "unheard", "", "the the w0 w1", texts[0])
    scores = sparse.bm25_scores(
        sparse.query_terms(batch.frame), index.postings, index.table("term_stats"), index.stats["n_chunks"], index.average_length
    )
    expected = sorted(tuple(r) for r in sparse.top_by_query(scores, top).select("query_id", "rank", "chunk_id", "score").collect())
    assert sorted(tuple(r) for r in sparse_arm(index, batch, top).collect()) == expected


def test_blocks_below_the_threshold_stay_closed(spark, zipf):
    index, texts = zipf
    rare = [t for t in texts[:200] if len(set(t.split())) > 12][:20]
    report = pruning_report(index, queries(spark, *rare), 1).collect()
    assert sum(r["postings_read"] for r in report) < 0.8 * sum(r["postings"] for r in report)
    assert all(0 < r["blocks_read"] <= r["blocks"] for r in report)


def test_shards_hold_all_postings_in_blocks(spark, zipf):
    index, texts = zipf
    rows = [r for r in index.table("shards").collect() if r["term"] is not None]
    for r in rows:
        assert r["df"] == len(r["locals"]) == sum(r["sizes"]) and len(r["ranges"]) == len(r["tops"]) == len(set(r["ranges"]))
        assert sorted({x // blocks.RANGE for x in r["locals"]}) == r["ranges"]
    held = sum(len(set(t.split())) for t in texts)
    assert sum(r["df"] for r in rows) == held == index.postings.count()


def test_small_shards_and_groups_of_queries_change_nothing(spark, zipf):
    index, texts = zipf
    batch = queries(spark, *texts[:12])
    asked, shards = sparse.query_terms(batch.frame), blocks.posting_shards(index.table("terms"), index.average_length, size=100)
    few = blocks.pruned_topk(asked, shards, index.table("term_stats"), index.stats["n_chunks"], index.average_length, 7, limit=20)
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_id", "score").collect())
    assert key(few) == key(sparse_arm(index, batch, 7))


def test_empty_index_has_no_hits(spark):
    index = build_index(chunk_rows(spark, [""]), scratch_path(spark, "none"))
    assert sparse_arm(index, queries(spark, "granite"), 5).count() == 0 and index.postings.count() == 0


@pytest.mark.parametrize("limit", [100, 4])
def test_short_queries_never_meet_the_product_of_all_vectors(spark, limit):
    """Queries with few components take the same rows from the vectors that hold them, zero scores included."""
    rng = np.random.default_rng(4)
    items = np.where(rng.random((300, 24)) < 0.1, rng.choice([-0.5, 0.25, 0.5, 1.0], size=(300, 24)), 0.0)
    items[::4] = items[1]
    asks = np.zeros((14, 24))
    for i in range(12):
        asks[i, rng.choice(24, size=1 + i % 4, replace=False)] = rng.choice([-1.0, 0.5, 1.0], size=1 + i % 4)
    asks[13] = rng.normal(size=24).round(1)  # one long query beside them, and one that is all zero
    vecs = spark.createDataFrame(
        [(f"i{i:03d}", [float(x) for x in v]) for i, v in enumerate(items)], "chunk_id string, vector array<float>"
    ).repartition(3)
    for some in (range(13), range(14)):
        qs = spark.createDataFrame([(f"q{q}", [float(x) for x in asks[q]]) for q in some], "query_id string, vector array<float>")
        got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in dense.dense_topk(vecs, qs, 40, max_batch=limit).collect()}
        sims = np.round(asks.astype(np.float32).astype(float) @ items.T, 6) + 0.0
        for q in some:
            order = sorted(range(300), key=lambda i: (-sims[q, i], f"i{i:03d}"))[:40]
            assert [got[f"q{q}", r] for r in range(1, 41)] == [(f"i{i:03d}", pytest.approx(sims[q, i], abs=1e-6)) for i in order]


def test_short_queries_use_the_lists_of_their_components(monkeypatch):
    """300 short queries over 9,000 vectors: no product with all vectors where positive scores suffice."""
    rng = np.random.default_rng(6)
    items = np.where(rng.random((9000, 32)) < 0.1, rng.random((9000, 32)), 0.0)
    asks = np.zeros((300, 32))
    for row in asks:
        row[rng.choice(32, size=2, replace=False)] = 0.5
    names = np.array([f"i{i:05d}" for i in range(9000)], dtype=object)
    q, v, s = dense.block_top(asks, items, 10)
    monkeypatch.setattr(dense, "block_top", None)
    found = dense._Short(asks, 10)
    for first in range(0, 9000, 3000):
        found.add(names[first : first + 3000], items[first : first + 3000])
    for i in range(300):
        assert [n for _, n in found.best[i]] == list(names[v[q == i]])


def test_short_queries_open_only_the_heads_of_lists(monkeypatch):
    """The best places of signed, tied and floored queries equal those of all scores; few of the places are opened."""
    rng = np.random.default_rng(9)
    table = np.where(rng.random((40, 6000)) < 0.3, rng.choice([-1.0, 1.0], size=(40, 6000)) * rng.random((40, 6000)) ** 6, 0.0).round(3)
    table[0] = 0.0
    word, place = np.nonzero(table)
    rank = rng.permutation(6000)
    found = lists.Lists(word, place, table[word, place], 40, rank)
    words = np.array([rng.choice(40, size=4, replace=False) for _ in range(200)])
    weights = rng.choice([-1.0, 0.5, 2.0], size=(200, 4)) * (np.arange(4) <= np.arange(200)[:, None] % 4)
    floors = np.where(np.arange(200) % 3 == 0, 0.9, -np.inf)
    opened = []
    monkeypatch.setattr(lists.Lists, "_opened", lambda self, *a, _of=lists.Lists._opened: opened.append(_of(self, *a)) or opened[-1])
    q, at, score = found.best(words, weights, floors, 5)
    for i in range(200):
        sums = np.round((weights[i][:, None] * table[words[i]]).sum(axis=0), 6)
        hits = np.flatnonzero((sums > 0) & (sums >= floors[i]))
        want = hits[np.lexsort((rank[hits], -sums[hits]))][:5]
        assert list(at[q == i]) == list(want) and np.allclose(score[q == i], sums[want])
    assert sum(map(len, opened)) < 0.2 * (table[words] != 0).sum(axis=2)[weights != 0].sum()


@pytest.mark.parametrize("limit", [3, 100])
def test_equal_vectors_are_searched_once_in_large_batches(spark, monkeypatch, limit):
    items = spark.createDataFrame([(f"i{i}", [float(i % 5), 1.0, 0.5]) for i in range(20)], "chunk_id string, vector array<float>")
    asks = spark.createDataFrame([(f"q{i:02d}", [1.0, 0.0, float(i % 2)]) for i in range(12)], "query_id string, vector array<float>")
    sent = []
    monkeypatch.setattr(dense, "_by_batch", lambda v, b, *a, _of=dense._by_batch: sent.append(b.num_rows) or _of(v, b, *a))
    got = sorted(tuple(r) for r in dense.dense_topk(items, asks, 3, max_batch=limit).collect())
    best = {0: [4.0] * 3, 1: [4.5] * 3}
    assert got == [(f"q{i:02d}", r + 1, c, best[i % 2][r]) for i in range(12) for r, c in enumerate(["i14", "i19", "i4"])]
    assert sum(sent) == (2 if limit == 3 else 12)


def test_few_frequent_words_are_answered_together(spark, zipf, monkeypatch):
    """Queries of few words are not looked at one by one, however many postings their words have."""
    index, texts = zipf
    batch = queries(spark, "w0 w1", "the w0", "w2 the w1", "the", "w5 unheard", texts[0])
    asked = sparse.query_terms(batch.frame)
    rows = blocks.weighted_terms(asked, index.table("term_stats"), index.stats["n_chunks"]).toPandas()
    known = blocks._Asked(rows)
    assert len(known.short) == 5 and sorted(known.words) == sorted(set(texts[0].split()))
    finder = blocks._Finder(known, index.average_length, 7)
    for name in ("_whole", "_open"):
        monkeypatch.setattr(blocks._Finder, name, None)
    known.words.clear()
    shard = {r["term"]: r for r in index.table("shards").filter("shard = 0").collect()}
    held = {}
    for term in known.number.keys() & shard.keys():
        r = shard[term]
        sat = blocks._saturated(np.array(r["tfs"], float), np.array(r["dls"]), index.average_length)
        held[term] = (r["ranges"], r["tops"], np.append(0, np.cumsum(r["sizes"])), np.array(r["locals"]), sat)
    finder.shard(pa.array(shard[None]["chunk_ids"]), held)
    assert sum(len(q) for q, *_ in finder.short.rows()) == 5 * 7


def test_few_rare_words_are_added_up_whole(spark, zipf, monkeypatch):
    index, texts = zipf
    batch = queries(spark, "w0 w1", "w3 w900", "w2", "the w7 w8 w9", "w5 unheard")
    scores = sparse.bm25_scores(
        sparse.query_terms(batch.frame), index.postings, index.table("term_stats"), index.stats["n_chunks"], index.average_length
    )
    expected = sorted(tuple(r) for r in sparse.top_by_query(scores, 30).select("query_id", "rank", "chunk_id", "score").collect())
    assert sorted(tuple(r) for r in sparse_arm(index, batch, 30).collect()) == expected
    report = {r["query_id"]: r for r in pruning_report(index, batch, 1).collect()}
    assert report["q2"]["postings_read"] == report["q2"]["postings"] > 0


def test_latin_texts_are_cut_without_the_unicode_tables(monkeypatch):
    texts = ["Straße_ÄÖÜ naïve-café 12½ ªº µ", "l’été – 10€", "ÇA-va Ça x²y ıŉ Ǆ"]
    want = [([w.lower() for w in counts._ANY.findall(t)], [w.lower() for w in counts._UPPER.findall(t)]) for t in texts]
    vectors = get_embedder().encode(texts)
    monkeypatch.setattr(counts, "_ANY", None)
    monkeypatch.setattr(counts, "_UPPER", None)
    assert [counts._words(t) for t in texts] == want and [counts.search_words(t) for t in texts] == [w for w, _ in want]
    assert np.array_equal(get_embedder().encode(texts), vectors) and not counts._PLAIN("İ") and not counts._PLAIN("石")


def test_chunks_counted_together_equal_the_column_functions(spark):
    texts = [
        "The granite-block granite 3rd an AN", "", "  ", "Straße ÄÖÜ İstanbul I\u0307 naïve café", "Ωμέγα ΟΔΟΣ ΣΑΣ. Σ", "Привет МИР мир-мир",
        "岩石 岩 石1", "नमस्ते दुनिया", "\U0001f600 smile x\u0301 \u2160\u00b2 ½", "a\u2028b it's re-use a1-b2 -- --x 123 12a", "E\u0301 ǅ ŉ ﬁ K",
    ] + [" ".join(f"W{i % 7} tail{i % 13}" for i in range(60))]
    rows = chunk_rows(spark, texts).union(chunk_rows(spark, ["x"]).withColumn("text", F.lit(None).cast("string")))
    assert 0 < rows.filter(F.col("text").rlike(SETTLED)).count() < rows.count()
    one = tx.with_term_counts(tx.with_keywords(rows, "text", 4), "text", search=True)
    want = one.select("chunk_id", (F.length("text") > 0).alias("has_text"), "terms", F.aggregate("terms", F.lit(0), lambda s, t: s + t["n"]).alias("dl"), "keywords")
    got = counted_chunks(rows, 4).select(want.columns)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want)


def test_a_lazy_index_writes_only_what_is_asked_for(spark):
    rows = chunk_rows(spark, ["granite resists frost", "granite needs water"])
    lazy, whole = (make(rows, scratch_path(spark, "test")) for make in (lazy_index, build_index))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(lazy.table("term_stats")) == key(whole.table("term_stats"))
    assert lazy.built == {"chunks", "terms", "term_stats"}
    for name in ("chunks", "terms", "stats", "shards", "vectors"):
        assert key(lazy.table(name)) == key(whole.table(name))
    assert key(lazy.postings) == key(blocks.postings_of(whole.table("shards")))
    assert "Exchange" not in lazy.postings._jdf.queryExecution().executedPlan().toString()
