import json
import random

import pytest
from pyspark.sql import functions as F

from quarrylight.contracts import ContractError, validate_intermediate
from quarrylight.operators import artifacts as A
from quarrylight.operators import classify as CL
from quarrylight.operators import sections as SE
from quarrylight.operators.captions import figure_captions, table_captions
from quarrylight.operators.chunking import document_chunks, document_meta
from quarrylight.plans.ingest import intermediate_documents, write_product
from quarrylight.sources import pages as PG

BLOCK = "doc_id string, page int, block_no int, label string, level int, size double, bold boolean, text string"


@pytest.mark.parametrize(
    "cov,n,noise,fonts,label",
    [
        (0.80, 200, 0.0599, 5, "scan-ocr"), (0.80, 199, 0.0, 5, "scan-image"), (0.7999, 900, 0.0, 2, "native"),
        (0.55, 900, 0.0, 1, "scan-ocr"), (0.5499, 900, 0.0, 1, "native"), (0.90, 900, 0.06, 1, "scan-image"),
    ],
)
def test_page_label(spark, cov, n, noise, fonts, label):
    assert spark.range(1).select(CL.page_label(F.lit(cov), F.lit(n), F.lit(noise), F.lit(fonts))).first()[0] == label


@pytest.mark.parametrize(
    "scanned,share,sig,value",
    [
        (False, 0.0, False, 1.0), (False, 0.0, True, 0.8), (True, 1.0, True, 1.0), (True, 1.0, False, 0.8),
        (True, 2 / 3, False, 0.6333), (True, 0.5, False, 0.55),
    ],
)
def test_confidence(spark, scanned, share, sig, value):
    assert spark.range(1).select(CL.confidence(F.lit(scanned), F.lit(share), F.lit(sig))).first()[0] == value


def test_page_sample(spark):
    get = lambda n: list(spark.range(1).select(CL.sampled_pages(F.lit(n))).first()[0])
    assert get(20) == [0, 2, 5, 7, 10, 12, 15, 17]
    assert get(8) == list(range(8)) and get(0) == []


def test_cover_page_has_no_vote_and_signature_counts(spark):
    traits = spark.createDataFrame(
        [("a", p, 3, 0.0 if p == 1 else 0.9, 900, 0.0, 1, 1) for p in (1, 2, 3)]
        + [("b", 1, 1, 0.9, 10, 0.0, 1, 2)],
        "doc_id string, page int, n_pages int, coverage double, n_chars int, noise double, n_fonts int, col_guess int",
    )
    info = spark.createDataFrame(
        [("a", "ABBYY FineReader", None), ("c", None, None)], "doc_id string, producer string, creator string"
    )
    got = {r["doc_id"]: r for r in CL.classify_documents(traits, info).collect()}
    assert (got["a"]["source_class"], got["a"]["source_confidence"]) == ("pdf-scan-ocr", 1.0)
    assert got["b"]["source_class"] == "pdf-scan-image" and got["b"]["route"] == "pdf-scan"
    assert (got["c"]["source_class"], got["c"]["source_confidence"], got["c"]["n_pages"]) == ("pdf-native", 0.0, 0)
    assert got["a"]["signals"]["page_labels"] == ["native", "scan-ocr", "scan-ocr"]


def test_coverage_and_columns(spark):
    pages = spark.createDataFrame([("d", 1, 100.0, 100.0), ("d", 2, 100.0, 100.0)], "doc_id string, page int, width double, height double")
    images = spark.createDataFrame([("d", 1, 0.0, 0.0, 50.0, 100.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    cov = {r["page"]: r["coverage"] for r in CL.image_coverage(images, pages).collect()}
    assert cov == {1: 0.5, 2: 0.0}
    blocks = spark.createDataFrame([("d", 1, x) for x in (10.0, 10.0, 60.0, 60.0)] + [("d", 2, 60.0)], "doc_id string, page int, x0 double")
    assert {r["page"]: r["col_guess"] for r in CL.column_guess(blocks, pages).collect()} == {1: 2, 2: 1}


def test_heading_stack(spark):
    heads = [(1, "A"), (2, "B"), (3, "C"), (2, "D"), (1, "E"), (3, "F")]
    df = spark.createDataFrame(
        [("d", 1, i, "section_header", lv, 0.0, False, t) for i, (lv, t) in enumerate(heads)], BLOCK
    )
    got = [list(r["section_path"]) for r in SE.sections(SE.mark_typed_headings(df), 9).orderBy("section_no").collect()]
    assert got == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"], ["E", "F"]]


def test_heading_stack_random(spark):
    rnd = random.Random(5)
    data, expected = [], {}
    for d in range(40):
        stack, n = [], 0
        for i in range(rnd.randint(1, 15)):
            lv = rnd.randint(1, 6)
            n += 1
            while stack and stack[-1][0] >= lv:
                stack.pop()
            stack.append((lv, f"h{i}"))
            data.append((f"d{d}", 1, i, "section_header", lv, 0.0, False, f"h{i}"))
            expected[(f"d{d}", n)] = [t for _, t in stack]
    found = SE.sections(SE.mark_typed_headings(spark.createDataFrame(data, BLOCK).repartition(3)), 9)
    assert {(r["doc_id"], r["section_no"]): list(r["section_path"]) for r in found.collect()} == expected


def test_lean_headings_and_markdown(spark):
    rows = [
        (1, 10.0, False, "intro text"), (2, 20.0, False, "Title"), (3, 10.0, False, "body one"),
        (4, 10.0, True, "Bold Minor"), (5, 10.0, False, "body two"), (6, 15.0, False, "Second"),
        (7, 10.0, True, "bold sentence."), (8, 20.0, False, "x" * 121),
    ]
    df = spark.createDataFrame([("d", 1, n, "text", None, s, b, t) for n, s, b, t in rows], BLOCK)
    heads = {r["block_no"]: r["heading"] for r in SE.mark_headings(df).collect()}
    assert heads == {1: 0, 2: 1, 3: 0, 4: 3, 5: 0, 6: 2, 7: 0, 8: 0}
    md = SE.markdown(SE.sections(SE.mark_headings(df))).first()["markdown"]
    assert md.startswith("intro text\n\n# Title\n\nbody one\n\n### Bold Minor\n\nbody two\n\n## Second\n\nbold sentence.")
    assert md.endswith("\n")


BOX = "doc_id string, page int, object_no int, x0 double, y0 double, x1 double, y1 double"
TEXT = "doc_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"


def test_captions(spark):
    objects = spark.createDataFrame([("d", 1, 1, 0.0, 100.0, 100.0, 200.0)], BOX)
    blocks = spark.createDataFrame(
        [
            ("d", 1, 1, 0.0, 80.0, 50.0, 95.0, "Figure 1  above"), ("d", 1, 2, 0.0, 270.0, 50.0, 290.0, "FIG. 2 below"),
            ("d", 1, 3, 0.0, 205.0, 50.0, 210.0, "plain text"), ("d", 2, 4, 0.0, 205.0, 50.0, 210.0, "Figure 3 elsewhere"),
            ("d", 1, 5, 0.0, 241.0, 50.0, 260.0, "Table 4 below"), ("d", 1, 6, 150.0, 205.0, 190.0, 210.0, "Figure 5 beside"),
            ("d", 1, 7, 0.0, 50.0, 50.0, 60.0, "Tab. 6 above"),
        ],
        TEXT,
    )
    assert figure_captions(objects, blocks).first()["caption"] == "FIG. 2 below"
    assert table_captions(objects, blocks).first()["caption"] == "Tab. 6 above"


def test_artifacts_are_filtered_and_numbered(spark):
    blocks = spark.createDataFrame([], TEXT)
    images = spark.createDataFrame(
        [("d", 1, 1, 0.0, 0.0, 10.0, 10.0), ("d", 1, 2, 0.0, 0.0, 50.0, 50.0), ("d", 2, 1, 0.123, 0.0, 80.0, 80.0)], BOX
    )
    figs = A.extract_figures(images, blocks).orderBy("id").collect()
    assert [(f["id"], f["page"], f["has_caption"]) for f in figs] == [("d-f1", 1, False), ("d-f2", 2, False)]
    assert figs[1]["bbox"][0] == 0.12
    grids = spark.createDataFrame(
        [("d", 1, 1, 0.0, 0.0, 1.0, 1.0, [["", None]], None, None), ("d", 1, 2, 0.0, 0.0, 1.0, 1.0, [["a  b", None], ["c", "d"]], None, None)],
        BOX + ", cells array<array<string>>, n_rows int, n_cols int",
    )
    t = A.extract_tables(grids, blocks).collect()
    assert len(t) == 1 and t[0]["id"] == "d-t1" and t[0]["cells"] == [["a b", ""], ["c", "d"]] and t[0]["n_cols"] == 2
    lines = spark.createDataFrame([("d", 1, 1, "prose"), ("d", 1, 2, " y = a + b (1) "), ("d", 2, 1, "E = mc^2")], "doc_id string, page int, line_no int, text string")
    assert [(e["id"], e["text"]) for e in A.extract_formulas(lines).orderBy("id").collect()] == [("d-e1", "y = a + b (1)"), ("d-e2", "E = mc^2")]


def test_typed_artifacts(spark):
    items = spark.createDataFrame([("d", 1, None, ["h1", "h2"], [["a", None]], " Cap ")], "doc_id string, seq int, page int, header array<string>, rows array<array<string>>, caption string")
    t = A.typed_tables(items).first()
    assert (t["id"], t["page"], t["n_rows"], t["n_cols"], t["cells"], t["caption"]) == ("d-t1", 1, 2, 2, [["h1", "h2"], ["a", ""]], "Cap")
    blocks = spark.createDataFrame([("d", 2, 1, "Formula", None, 0.0, False, "a^2")], BLOCK)
    e = A.typed_formulas(blocks).first()
    assert (e["id"], e["latex"], e["source"]) == ("d-e1", "a^2", "docling")


def full_document(spark):
    return spark.createDataFrame(
        [(
            "doc", "# T\n\nbody\n",
            [(1, "T", 1, ["T"], "body"), (2, "Empty", 2, ["T", "Empty"], " "), (0, "", 3, [], "tail")],
            [("doc-t1", 1, 1, 2, [["a", "b"]], "Table 1"), ("doc-t2", 1, 0, 0, [], None)],
            [("doc-f1", 2, None, True, "Figure 1 x")], [("doc-e1", 3, "", "heuristic", "y = x")],
        ), ("none", "", [], [], [], [])],
        "document string, markdown string, "
        "sections array<struct<level:int,title:string,page:int,section_path:array<string>,body:string>>, "
        "tables array<struct<id:string,page:int,n_rows:int,n_cols:int,cells:array<array<string>>,caption:string>>, "
        "figures array<struct<id:string,page:int,bbox:array<double>,has_caption:boolean,caption:string>>, "
        "formulas array<struct<id:string,page:int,latex:string,source:string,text:string>>",
    )


def test_chunks_of_a_document(spark):
    got = document_chunks(full_document(spark)).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["kind"], r["text"], r["artifact_id"]) for r in got] == [
        ("doc-c1", "text", "T\n\nbody", None), ("doc-c2", "text", "tail", None),
        ("doc-c3", "table", "Table 1\na | b", "doc-t1"), ("doc-c4", "table", "Table doc-t2", "doc-t2"),
        ("doc-c5", "figure", "Figure 1 x", "doc-f1"), ("doc-c6", "formula", "y = x", "doc-e1"),
    ]
    meta = {r["id"]: r for r in document_meta(full_document(spark)).collect()}
    assert (meta["doc"]["n_chunks"], meta["doc"]["n_tables"], meta["doc"]["status"]) == (6, 2, "ok")
    assert meta["none"]["status"] == "needs_human_review" and meta["none"]["errors"] == ["no chunks produced"]


def test_markdown_fallback_chunk(spark):
    df = full_document(spark).filter("document = 'doc'").withColumn("sections", F.expr("filter(sections, s -> false)"))
    first = document_chunks(df).orderBy("chunk_id").first()
    assert (first["text"], first["kind"]) == ("# T\n\nbody", "text")


def test_intermediate_contract():
    with pytest.raises(ContractError, match="formulas"):
        validate_intermediate({"document": "d", "markdown": "", "tables": [], "figures": []})


def test_html_to_product(spark, tmp_path):
    html = (
        "<html><head><title>x</title></head><body><script>var a = '<p>no</p>';</script><h1>Main &amp; Title</h1>"
        "<p>First <b>para</b>.</p><!-- <p>no</p> --><h2>Sub</h2><p>Second<p>Third</body></html>"
    )
    pages = spark.createDataFrame([("w", html)], "id string, html string")
    blocks = PG.html_blocks(pages, F.col("id"))
    assert [r["text"] for r in blocks.orderBy("block_no").collect()] == ["Main & Title", "First para .", "Sub", "Second", "Third"]
    docs = intermediate_documents(blocks, typed=True)
    out = str(tmp_path / "outputs")
    row = write_product(docs, out).first()
    assert (row["doc_id"], row["n_chunks"], row["status"]) == ("w", 2, "ok")
    lines = [json.loads(x) for x in (tmp_path / "outputs/w/chunks.jsonl").read_text().splitlines()]
    assert lines[1]["section_path"] == ["Main & Title", "Sub"] and lines[1]["text"] == "Sub\n\nSecond\n\nThird"
    meta = json.loads((tmp_path / "outputs/w/document.meta.json").read_text())
    assert meta["n_chunks"] == 2 and meta["doi"] is None and "source_signals" not in meta
    assert (tmp_path / "outputs/w/document.md").read_text().startswith("# Main & Title")


def test_html_blocks_keep_all_readable_text(spark):
    html = (
        'loose start<div class="ad">Advice</div><nav><ul><li>One</li><li>Two</li></ul></nav><H2 id="x">Head</H2>between'
        "<p>First</p>after<table><tr><td>a</td><td>b</td></tr></table><style>p{}</style><script>if (a<b) {'</nav>'}</script><footer>&copy; end</footer>tail"
    )
    pages = spark.createDataFrame([("w", html), ("x", None), ("y", "")], "id string, html string")
    rows = PG.html_blocks(pages, F.col("id")).orderBy("block_no").collect()
    assert [(r["label"], r["text"]) for r in rows] == [
        ("text", "loose start"), ("text", "Advice"), ("list_item", "One"), ("list_item", "Two"), ("section_header", "Head"), ("text", "between"),
        ("text", "First"), ("text", "after"), ("text", "a"), ("text", "b"), ("text", "&copy; end"), ("text", "tail"),
    ]
    assert rows[4]["level"] == 2 and rows[4]["size"] == 17.0


def test_engine_choice(monkeypatch):
    monkeypatch.setenv("QUARRYLIGHT_ENGINE", "Other")
    assert PG.choose_engine("LEAN") == "lean" and PG.choose_engine() == "other"
    monkeypatch.delenv("QUARRYLIGHT_ENGINE")
    assert PG.choose_engine() in ("lean", "docling")
