import hashlib
import random

from quarrylight.llm import substrings

SCHEMA = "doc_id long, text string, removed_words string, first int"


def naive(docs):
    """Texts after removal, by walking all spans of all documents in order."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    seen, covered = set(), {}
    for d, text in order:
        data = (text or "").encode()
        _, counts, contents = substrings.sentences(data)
        gone = set()
        for start in range(len(counts)):
            stop, words = start, 0
            while stop < len(counts) and (stop - start < 2 or words < 20):
                words += counts[stop]
                stop += 1
            if stop - start < 2 or words < 20:
                continue
            span = b" ".join(contents[start:stop])
            if span in seen:
                gone |= set(range(start, stop))
            seen.add(span)
        covered[(d, text)] = gone
    out = []
    for d, text in docs:
        if text is None:
            out.append((d, None, 0))
            continue
        data = text.encode()
        starts, _, _ = substrings.sentences(data)
        edges = [*starts, len(data)]
        gone = covered[(d, text)]
        kept = data[: edges[0]] + b"".join(data[edges[i] : edges[i + 1]] for i in range(len(starts)) if i not in gone)
        out.append((d, kept.decode(), len(gone)))
    return sorted(out, key=str)


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n)).capitalize() + rng.choice([".", "!", "?"])


def corpus(seed):
    rng = random.Random(seed)
    passages = [" ".join(sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(3, 8))) for _ in range(6)]
    docs = []
    for d in range(60):
        parts = [sentence(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(0, 12))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        docs.append((d, rng.choice([" ", "\n", "  \n"]).join(parts)))
    return docs


def test_rest_equals_brute_force(spark):
    docs = corpus(1) + [(70, None), (71, ""), (72, " \n "), (3, corpus(1)[3][1]), (None, corpus(1)[5][1]), (80, "same " * 30_000)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA).repartition(4)
    got = substrings.remove_repeats(frame)
    assert got.columns == ["doc_id", "text", "first", "removed_sentences", "removed_words", "source_ids"]
    rows = sorted(((r["doc_id"], r["text"], r["removed_sentences"]) for r in got.collect()), key=str)
    assert rows == naive(docs)
    assert any(r[2] for r in rows)


def test_passages_of_fifty_words_are_caught_and_clean_documents_stay(spark):
    rng = random.Random(7)
    passage = " ".join(sentence(rng, n) for n in (18, 14, 9, 16))
    own = {d: [sentence(rng, 12) for _ in range(6)] for d in range(30)}
    docs = [(d, " ".join([*own[d][:3], passage, *own[d][3:]] if d % 3 == 0 else own[d])) for d in own]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d in own:
        caught = d % 3 == 0 and d > 0
        assert (got[d]["removed_words"] == 57) == caught and (got[d]["removed_words"] == 0) == (not caught)
        assert got[d]["source_ids"] == ([0] if caught else [])


def test_long_sentences_are_cut_evenly():
    text = ("w " * 45 + "end. Next one.").encode()
    starts, counts, contents = substrings.sentences(text)
    assert counts == [20, 20, 6, 2]
    assert b" ".join(contents) == b" ".join(text.lower().split())
    assert starts[0] == 0 and text[starts[3] :] == b"Next one."


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest_is_of_content_alone():
    a = substrings.sentences(b"One  two.\nThree FOUR.")
    b = substrings.sentences(b"one two. three four.")
    assert a[2] == b[2] and hashlib.md5(b" ".join(a[2])).digest() == hashlib.md5(b"one two. three four.").digest()


def covered(a, b):
    """Sentence contents of ``b`` that spans of ``a`` cover, and all of ``b``."""
    held = {d for *_, d in substrings.ending_spans(*substrings.sentences(a.encode())[1:])}
    _, counts, contents = substrings.sentences(b.encode())
    gone = {i for first, stop, d in substrings.ending_spans(counts, contents) if d in held for i in range(first, stop)}
    return sum(counts[i] for i in gone), b" ".join(contents[i] for i in sorted(gone))


def test_unpunctuated_passages_at_any_offset_are_found():
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    found = []
    for _ in range(200):
        passage = words(50)
        ahead, behind = rng.sample(range(1, 60), 2)
        n, text = covered(words(ahead) + " " + passage + " " + words(20), words(behind) + " " + passage + " " + words(20))
        assert text.decode() in passage
        found.append(n)
    assert sum(n >= 20 for n in found) >= 0.97 * len(found) and sum(found) / len(found) >= 35


def test_every_sentence_of_a_passage_is_covered(spark):
    rng = random.Random(8)
    passage = " ".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) + "." for n in (15, 10, 5))
    docs = [(1, "One two three. " + passage), (2, "Four five six. " + passage + " Last.")]
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), ends=True).collect()}
    assert (got[1]["removed_words"], got[2]["removed_words"]) == (0, 30) and got[2]["text"] == "Four five six. Last."


def test_scripts_without_spaces_count_signs():
    rng = random.Random(9)
    signs = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    passage = signs(12) + "\u3002" + signs(14) + "\u3002"
    n, text = covered(signs(7) + "\u3002" + passage, signs(9) + "\uff01" + passage + signs(5))
    assert n == 28 and text.decode().replace(" ", "") == passage


def test_spans_are_shuffled_once_and_texts_go_through_python_once(spark):
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string")
    plan = substrings.repeated_spans(docs, ends=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("MapInArrow") == 1
    rest = substrings.remove_repeats(docs, ends=True).where("removed_sentences > 0")
    assert rest._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["doc_id"] for r in rest.collect()} == {d for d, _, n in naive(corpus(2)) if n}


def test_one_span_in_all_documents(spark):
    rng = random.Random(12)
    passage = " ".join(sentence(rng, 15) for _ in range(3))
    docs = spark.createDataFrame([(d, passage) for d in [None, *range(20_000)]], "doc_id long, text string")
    rows = substrings.remove_repeats(docs.repartition(4), ends=True).groupBy("removed_sentences", "source_ids").count().collect()
    assert {(r[0], tuple(r[1])): r[2] for r in rows} == {(0, ()): 1, (3, (0,)): 20_000}
