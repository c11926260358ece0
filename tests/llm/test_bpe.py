import hashlib
import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarrylight.llm import bpe as B

pytestmark = pytest.mark.skipif(not os.path.exists(B.VOCABULARY), reason="no vocabulary file")
TEXTS = [
    "Hello world, it's 12 o'clock.", None, "", "naïve Übung  日本語 ñ  \n\n\tx", "a<|endoftext|>b <|endoftext|><|endoftext|>", "x" * 3000,
    "Hello world, it's 12 o'clock.", "՘՘ a\U00033000 1₀", " " * 50 + "end", "日本語" * 400, "\x1c\x85 　 y", "we'll'RE 'd",
]


def library():
    return Tokenizer.from_file(B.VOCABULARY)


def random_text(rng, alphabet="aaabbb  \n\t'stre<|endoftext|>12é日本語ñ̃‍\u0085　\x1c՘\U0001f600\U00033000", size=40):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, size)))


def merged_plainly(vocab, data):
    """One merge at a time, the first pair of the lowest rank."""
    symbols = [int(vocab.byte_id[b]) for b in data]
    while True:
        ranks = [int(vocab.rank(np.array([a]), np.array([b]))[0]) for a, b in zip(symbols, symbols[1:])]
        if not ranks or min(ranks) >= B._NONE:
            return symbols
        at = ranks.index(min(ranks))
        symbols[at : at + 2] = [int(vocab.made[ranks[at]])]


def test_rounds_equal_one_merge_at_a_time():
    vocab, rng = B.vocabulary(B.VOCABULARY), random.Random(3)
    for _ in range(60):
        data = bytes(rng.choice(b"aabthe ing\xc3\xa9") for _ in range(rng.randint(1, 60)))
        expected = merged_plainly(vocab, data)
        assert vocab._long(data).tolist() == expected
        ids, _ = vocab._rounds(vocab.byte_id[np.frombuffer(data, np.uint8)], np.zeros(len(data), np.int64))
        assert ids.tolist() == expected


def test_equal_to_the_library():
    vocab, theirs, rng = B.vocabulary(B.VOCABULARY), library(), random.Random(5)
    texts = [t or "" for t in TEXTS] + [random_text(rng) for _ in range(3000)]
    for text, size in [(t, s) for t in texts for s in (B.PIECE, 5)]:
        expected = theirs.encode(text, add_special_tokens=False).ids
        ids = vocab.encode(text, size)
        assert ids.tolist() == expected
        assert vocab.decode(ids).decode("utf-8", "replace") == theirs.decode(expected, skip_special_tokens=False)


def test_word_classes_of_all_characters():
    theirs = library().pre_tokenizer
    for code in [*range(0, 0x3400, 7), *range(0x550, 0x5A0), 0x1C89, 0xA7CE, 0x10D4E, 0x1246F, 0x33479, 0x3D000]:
        if not 0xD800 <= code < 0xE000:
            for base in "a1! ":
                text = base + chr(code) + "b"
                assert len(B.words(text)) == len(theirs.pre_tokenize_str(text)), hex(code)


def test_long_words_and_forgetting(monkeypatch):
    vocab, theirs = B.Vocabulary(__import__("json").load(open(B.VOCABULARY))), library()
    monkeypatch.setattr(B, "KNOWN_WORDS", 20)
    monkeypatch.setattr(B, "SHORT", 12)
    rng = random.Random(7)
    for _ in range(40):
        text = " ".join(random_text(rng, "abcdefgetion日本", 60) for _ in range(10))
        assert vocab.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_frames(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "c", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, `a.b` int")
    theirs = library()
    expected = {i if i != 3 else None: theirs.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    coded = B.encode(docs)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == expected
    back = {r["doc_id"]: r["text"] for r in B.decode(coded).collect()}
    assert back == {i if i != 3 else None: t or "" for i, t in enumerate(TEXTS)}
    rows = {r["doc_id"]: r for r in B.round_trip(docs).collect()}
    for i, ids in expected.items():
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert B.round_trip(none).count() == 0 and B.encode(none).count() == 0
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'6162FF63E697' AS STRING) AS text")
    assert B.decode(B.encode(odd)).first()["text"] == "ab�c�"
    ids = spark.createDataFrame([(1, None), (2, []), (3, [0, None, 99999, -1, 0])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in B.decode(ids).collect()} == {1: None, 2: "", 3: "!!"}


def test_wrong_vocabularies_raise():
    content = __import__("json").load(open(B.VOCABULARY))
    with pytest.raises(ValueError):
        B.Vocabulary(content | {"model": content["model"] | {"byte_fallback": True}})
    with pytest.raises(ValueError):
        B.Vocabulary(content | {"model": content["model"] | {"merges": content["model"]["merges"][::-1]}})


def test_query_equals_the_library(spark, small):
    from quarrylight.llm.queries import op11_bpe
    from quarrylight.sources.corpus import table

    theirs = library()
    rows = {r["doc_id"]: r for r in op11_bpe(spark, small).collect()}
    docs = table(spark, small, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = theirs.encode(doc["text"] or "", add_special_tokens=False).ids
        assert rows[doc["doc_id"]]["n_tokens"] == len(ids)
        assert rows[doc["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
