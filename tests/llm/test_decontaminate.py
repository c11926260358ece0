import random
import re

from pyspark.sql import functions as F

from quarrylight.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = WORD.findall(low)
    if len(words) < 5:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(text):
    return " ".join(WORD.findall("".join(c.lower() if c.isascii() else c for c in text or "")))


def size_of(text):
    return len(plain(text).split(" "))


def naive(docs, items):
    out = []
    for d, text in docs:
        held = shingles(text)
        for i, item in items:
            of = shingles(item)
            if of and size_of(item) < 5:
                if f" {next(iter(of))} " in f" {plain(text)} ":
                    out.append((d, i, 1))
            elif of and len(of & held) / len(of) >= 0.8:
                out.append((d, i, len(of & held)))
    return sorted(out, key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Übung", "naïve", "東京"]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.choice([1, 3, 5, 6, 9, 14, 40, 90, 300]))) for i in range(60)]
    items += [(100, None), (101, ""), (102, "..."), (7, items[7][1]), (None, "an item with no id at all here")]
    docs = [(d, item(rng.choice([0, 2, 30, 300]))) for d in range(60)]
    for d in range(60, 140):
        words = items[d % 60][1].split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "changed"
        around = item(rng.choice([0, 5, 200, 8000]))
        cut = rng.randrange(len(around) + 1)
        docs.append((d, around[:cut].rsplit(" ", 1)[0] + "\n" + ", ".join(words).upper() + "; " + around[cut:]))
    docs += [(1, None), (2, ""), (3, "an item, with NO id; at all here"), (3, "an item, with NO id; at all here"), (None, items[8][1])]
    return docs, items


def test_matches_equal_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, shared int, item_id string").repartition(3)
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, id int")
    got = decontaminate.contained_items(frame, bench).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["shared"]) for r in got), key=str) == naive(docs, items)
    bad = {d for d, *_ in naive(docs, items)}
    clean = decontaminate.decontaminate(frame, bench)
    assert clean.columns == frame.columns
    keep = [d for d, t in docs if not any(x[0] == d for x in naive([(d, t)], items))]
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted(keep, key=str)
    assert bad


def test_item_blocks_give_the_same(spark, monkeypatch):
    docs, items = corpus(9)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 500)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(frame, bench.coalesce(1)).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["shared"]) for r in got), key=str) == naive(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words in a row here")], "doc_id long, text string")
    none, bench = docs.where("false"), docs.select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.contained_items(none, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.where("false")).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == 1
    assert decontaminate.decontaminate(docs, bench).count() == 0


def test_items_of_few_words_are_found_inside_texts(monkeypatch):
    monkeypatch.setattr("quarrylight.llm.words.BLOCK", 16)
    text = b"one two Three; four five six seven " + b"more words " * 50 + b"at the very end"
    items = [(0, b"three four five"), (1, b"very end"), (2, b"three five"), (3, b"end"), (4, b"fou"), (5, b""), (6, b"one two three four five six")]
    block = decontaminate.ItemBlock(items, 5, 0.8)
    assert [block.ids[i] for i, _ in block.matches(text)] == [0, 1, 3, 6]
    assert block.matches(b"three") == [] and block.matches(None) == []


def test_bins_grow_with_the_partition():
    sizes = [decontaminate.bins_for(30, 1 << k, 0.8) for k in range(5, 20)]
    assert sizes == sorted(sizes) and sizes[-1] > 100 * sizes[0]


def test_short_items_are_never_missed():
    rng = random.Random(2)
    text = [b"v%d" % rng.randrange(10**9) for _ in range(1028)]
    items = [(n, b" ".join(text[n : n + 5 + n % 2])) for n in range(1000)]
    block = decontaminate.ItemBlock(items, 5, 0.8)
    assert [i for i, _ in block.matches(b" ".join(text))] == list(range(1000))


def test_bins_keep_the_miss_of_longer_items():
    rng = random.Random(4)
    for size in (16, 17, 40):
        bins = decontaminate.bins_for(size, 1024, 0.8)
        shared, missed = -(-size * 8 // 10), 0
        for _ in range(3000):
            draw = lambda n: decontaminate.np.array([rng.getrandbits(64) for _ in range(n)], decontaminate.np.uint64)
            both = draw(shared)
            item = decontaminate.sketch(decontaminate.np.unique(decontaminate.np.append(both, draw(size - shared))), bins)
            text = decontaminate.sketch(decontaminate.np.unique(decontaminate.np.append(both, draw(1024 - shared))), bins)
            missed += not set(item.tolist()) & set(text.tolist())
        assert missed == 0
