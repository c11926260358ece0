from collections import Counter
import re

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import fixed, text as tx


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("r")).first()["r"]


def test_keywords_tie_by_first_seen(spark):
    df = spark.createDataFrame([(1, "beta alpha gamma alpha beta delta"), (2, ""), (3, None)], "id int, t string")
    got = {r["id"]: list(r["keywords"]) for r in tx.with_keywords(df, "t", 3).collect()}
    assert got == {1: ["beta", "alpha", "gamma"], 2: [], 3: []}


def test_counts_match_plain_counter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {
        r["doc_id"]: {t["term"]: t["n"] for t in r["terms"]}
        for r in tx.with_term_counts(docs, "text").select("doc_id", "terms").collect()
    }
    stop = set(fixed.KEYWORD_STOP)
    for r in docs.collect():
        words = [w.lower() for w in re.findall(fixed.WORD_PATTERN, r["text"])]
        assert got[r["doc_id"]] == Counter(w for w in words if w not in stop)


@pytest.mark.parametrize(
    "raw,doi",
    [
        ("https://doi.org/10.1000/ab.c", "10.1000/ab.c"),
        ("DOI: 10.1000/x", "10.1000/x"),
        ("10.12/x", None),
        ("  https://dx.doi.org/10.12345/z z", "10.12345/z"),
        ("plain", None),
    ],
)
def test_doi(spark, raw, doi):
    assert one(spark, tx.normalize_doi(F.col("x")), x=raw) == doi


@pytest.mark.parametrize(
    "path,slug",
    [("/a/My Paper (v2).PDF", "my-paper-v2"), ("x/.pdf", "pdf"), ("---.pdf", "document"), ("a.b.c", "a-b")],
)
def test_slug(spark, path, slug):
    assert one(spark, tx.slug_from_path(F.col("x")), x=path) == slug


def test_doi_slug_and_digest(spark):
    assert one(spark, tx.doi_slug(F.col("x")), x="10.1000/ab(c)") == "10.1000_ab_c"
    assert one(spark, tx.doi_slug(F.col("x")), x="//") == "fetched"
    assert one(spark, tx.digest16(F.col("x")), x="abc") == "ba7816bf8f01cfea"


@pytest.mark.parametrize(
    "query,scope,strength",
    [
        ("compare A and B across trials", "global", 2),
        ("what is the definition", "local", 2),
        ("plain words", "local", 0),
        ("compare the table", "local", 0),
        ("how do they differ: differences", "global", 2),
        ("a stable unit", "local", 1),
        ("A vs B", "global", 1),
    ],
)
def test_lexical_scope(spark, query, scope, strength):
    r = one(spark, tx.lexical_scope(F.col("x")), x=query)
    assert (r["scope"], r["strength"]) == (scope, strength)


@pytest.mark.parametrize(
    "line,yes",
    [
        ("y = a + b*x (3)", True),
        ("E = mc^2", True),
        ("We saw this in trial (3)", False),
        ("a plain sentence.", False),
        ("=", False),
        ("x=1", True),
    ],
)
def test_formula(spark, line, yes):
    assert one(spark, tx.is_formula(F.col("x")), x=line) is yes


def test_noise(spark):
    assert one(spark, tx.noise_ratio(F.col("x")), x="ab\u0001ﬁ c�") == pytest.approx(3 / 6)
    assert one(spark, tx.noise_ratio(F.col("x")), x="  ") == 0.0


def test_table_text(spark):
    df = spark.createDataFrame(
        [("Cap", [["a", ""], ["", ""], ["b", "c"]]), ("", [["x", None]]), (None, None)],
        "caption string, cells array<array<string>>",
    )
    got = [r[0] for r in df.select(tx.table_text(F.col("caption"), F.col("cells"))).collect()]
    assert got == ["Cap\na\nb | c", "x", ""]


def test_scanner_signature_and_ascii(spark):
    assert one(spark, tx.has_scanner_signature(F.col("x"), F.lit(None)), x="ABBYY FineReader 9")
    assert not one(spark, tx.has_scanner_signature(F.col("x"), F.lit("LaTeX")), x="pdfTeX")
    assert one(spark, tx.ascii_only(F.col("x")), x="naïve") == "na?ve"
