import pytest

from quarrylight.llm import mixing, quality, simhash, token_shards


def test_columns_with_dots_and_backticks_stay(spark):
    docs = spark.createDataFrame(
        [(1, "one two three four", "a", "x", 1), (2, "five six seven", None, "y", 2)],
        "doc_id long, text string, source string, `a.b` string, `c``d` int",
    )
    for got in (mixing.mix(docs), simhash.keep_one(docs), quality.with_views(docs).drop("__q_text", "__q_meta")):
        assert got.columns == docs.columns
        assert {(r["doc_id"], r["a.b"], r["c`d"]) for r in got.collect()} == {(1, "x", 1), (2, "y", 2)}


def test_vocabularies_that_do_not_fit_are_refused(tmp_path, monkeypatch):
    path = tmp_path / "wide.tiktoken"
    monkeypatch.setattr(token_shards.SparkFiles, "get", lambda name: str(path))
    for number in (token_shards.END, 1 << 16):
        path.write_text(f"YQ== {number}\n")
        token_shards._encoding.cache_clear()
        with pytest.raises(ValueError):
            token_shards._encoding("wide.tiktoken")
    token_shards._encoding.cache_clear()
