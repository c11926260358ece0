import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarrylight import recipe as R
from quarrylight.cli import main
from quarrylight.contracts import FetchBlocked, audit_chunks
from quarrylight.plans.fetch import contact_address, fetch, fetch_all
from quarrylight.plans.index import build_index
from quarrylight.plans.tools import CorpusTools
from quarrylight.sources import products as P
from quarrylight.sources.responses import crossref_url, europepmc_url, file_suffix, unpaywall_url
from quarrylight.streaming.chunks import chunk_stream, land_chunks, landed_chunks


# Workers cannot import this file, so its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def line(i, doc="d1", **kw):
    return {"chunk_id": f"{doc}-c{i}", "doc_id": doc, "kind": "text", "text": f"text {i} granite", "section_path": ["S"], "page": 1, **kw}


@pytest.fixture()
def outputs(tmp_path):
    root = tmp_path / "outputs"
    for doc in ("d1", "d2"):
        (root / doc / "tables").mkdir(parents=True)
        (root / doc / "chunks.jsonl").write_text("\n".join(json.dumps(line(i, doc)) for i in (1, 2)) + "\n\n")
        meta = {"id": doc, "source": "pdf-native" if doc == "d1" else "pdf-scan-ocr", "n_chunks": 2, "n_tables": 1, "n_figures": 0, "n_formulas": 0, "source_confidence": 0.9}
        (root / doc / "document.meta.json").write_text(json.dumps(meta, indent=2))
        (root / doc / "document.md").write_text(f"# {doc}\n")
        (root / doc / "tables" / f"{doc}-t1.table.json").write_text(json.dumps({"id": f"{doc}-t1", "cells": [["a"]]}))
    return root


def test_tolerant_and_strict_scan(spark, outputs):
    assert P.scan_chunks(spark, str(outputs)).count() == 4
    assert P.scan_chunks_strict(spark, str(outputs)).count() == 4
    bad = outputs / "d1" / "chunks.jsonl"
    bad.write_text(json.dumps(line(1)) + "\n{broken\n")
    assert P.scan_chunks(spark, str(outputs)).count() == 3
    with pytest.raises(ValueError, match=r"chunks.jsonl:2"):
        P.scan_chunks_strict(spark, str(outputs))
    bad.write_text(json.dumps(line(1, kind="weird")) + "\n")
    with pytest.raises(Exception, match="invalid kind"):
        P.scan_chunks_strict(spark, str(outputs)).collect()
    with pytest.raises(ValueError, match="no chunks"):
        P.scan_chunks_strict(spark, str(outputs / "nothing"))


def test_label_fallback_and_contract(spark, outputs):
    (outputs / "d1" / "chunks.jsonl").write_text(
        json.dumps({"chunk_id": "d1-c1", "doc_id": "d1", "kind": "figure", "artifact_id": "d1-f1", "caption": "Cap"}) + "\n"
        + json.dumps({"chunk_id": "d1-c2", "doc_id": "d1", "kind": "table", "artifact_id": "d1-t1"}) + "\n"
    )
    texts = {r["chunk_id"]: r["text"] for r in P.scan_chunks_strict(spark, str(outputs)).collect()}
    assert texts["d1-c1"] == "Cap" and texts["d1-c2"] == "table d1-t1"
    rows = [("a", "d", None, "x", None), ("b", "d", "weird", "x", None), ("c", "d", "text", "", None), ("e", "d", "table", "x", ""), ("f", "d", "text", "x", None)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, kind string, text string, artifact_id string")
    got = [r["violation"] for r in audit_chunks(df).orderBy("chunk_id").collect()]
    assert got == ["missing kind", "invalid kind", "text chunk has no text", "missing artifact_id", None]


def test_latest_chunk_wins(spark, outputs):
    (outputs / "d2" / "chunks.jsonl").write_text(json.dumps(line(1, "d1", text="newer")) + "\n")
    got = {r["chunk_id"]: r["text"] for r in P.latest_chunks(spark, str(outputs)).collect()}
    assert got["d1-c1"] == "newer" and len(got) == 2


def test_metadata(spark, outputs):
    (outputs / "d3").mkdir()
    (outputs / "d3" / "document.meta.json").write_text("{not json")
    meta = P.scan_meta(spark, str(outputs)).filter("id IS NOT NULL")
    assert [r["id"] for r in P.list_documents(meta).collect()] == ["d1", "d2"]
    assert {r["doc_id"]: r["doc_class"] for r in P.document_sources(meta).collect()} == {"d1": "native", "d2": "scan"}
    one = spark.createDataFrame([("smith-2003-x", "html", None, None, 3, "s")], "id string, source string, n_chunks int, n_tables int, n_formulas int, slug string")
    f = P.document_features(one).first()
    assert (f["source"], f["year"], f["n_chunks"], f["has_tables"], f["has_formulas"]) == ("scan", 2003, 0, False, True)
    assert P.document_sources(one).first()["doc_class"] == "unknown"


def test_gold_and_doi_list(spark, tmp_path):
    items = [{"id": "1", "scope": "local", "question": "q", "gold_chunk_ids": ["a"]}, {"id": "2", "question": "r", "gold_chunk_ids": [], "answerable": False}]
    (tmp_path / "a.json").write_text(json.dumps(items))
    (tmp_path / "b.json").write_text(json.dumps({"items": items}))
    for name in ("a.json", "b.json"):
        assert sorted(r["id"] for r in P.scan_gold(spark, str(tmp_path / name)).collect()) == ["1", "2"]
    (tmp_path / "dois.txt").write_text("# head\n10.1000/a # note\n\n10.1000/b\n")
    assert sorted(r["doi"] for r in P.doi_list(spark, str(tmp_path / "dois.txt")).collect()) == ["10.1000/a", "10.1000/b"]


def test_tools(spark, outputs):
    ix = build_index(P.scan_chunks_strict(spark, str(outputs)), str(outputs.parent / "index"))
    recipe = R.resolve({"corpus": {"outputs_dir": "outputs"}, "index": {"path": "index"}}, str(outputs.parent))
    tools = CorpusTools(spark, recipe, ix)
    assert all(callable(getattr(tools, n)) for n in CorpusTools.NAMES) and len(CorpusTools.NAMES) == 6
    hits = tools.search_corpus("granite text", top_k=2)
    assert len(hits) == 2 and hits[0]["citation"]["doc_id"] in ("d1", "d2") and "artifact_id" not in hits[0]["chunk"]
    assert len(tools.search_corpus("granite", top_k=3, multi_query=True)) == 3
    assert len(tools.search_corpus("granite", top_k=1, sub_queries=["text"])) == 1
    assert [d["id"] for d in tools.list_documents()] == ["d1", "d2"]
    assert tools.get_document("d1") == "# d1\n" and tools.get_document("zz").startswith("error: document not found")
    assert tools.get_table("d1-t1")["cells"] == [["a"]]
    assert "not a figure id" in tools.get_figure("d1-t1")["error"]
    assert "unrecognized" in tools.get_table("nope")["error"] and "not found" in tools.get_formula("d1-e9")["error"]


EPMC = {"resultList": {"result": [{"pmcid": "PMC1", "isOpenAccess": "Y", "fullTextUrlList": {"fullTextUrl": [
    {"url": "https://x/s.html", "documentStyle": "html", "availability": "Free"}, {"url": "https://x/a.pdf", "documentStyle": "pdf", "availability": "Open access"}]}}]}}


@pytest.mark.parametrize(
    "fn,body,url",
    [
        (europepmc_url, EPMC, "https://x/a.pdf"),
        (europepmc_url, {"resultList": {"result": [{"pmcid": "PMC7", "inEPMC": "y"}]}}, "https://www.ebi.ac.uk/europepmc/webservices/rest/PMC7/fullTextPDF"),
        (europepmc_url, {"resultList": {"result": []}}, None),
        (unpaywall_url, {"is_oa": True, "best_oa_location": {"url_for_pdf": None, "url": "u"}}, "u"),
        (unpaywall_url, {"is_oa": True, "best_oa_location": None, "oa_locations": [{"url": "n"}, {"url_for_pdf": "p"}]}, "p"),
        (unpaywall_url, {"is_oa": False, "best_oa_location": {"url": "u"}}, None),
        (crossref_url, {"message": {"link": [{"URL": "https://x/b.PDF", "content-type": "unspecified"}, {"URL": "c", "content-type": "application/pdf"}]}}, "c"),
        (crossref_url, {"message": {"link": [{"URL": "https://x/b.PDF", "content-type": "unspecified"}]}}, "https://x/b.PDF"),
        (crossref_url, {}, None),
    ],
)
def test_registry_links(spark, fn, body, url):
    assert spark.createDataFrame([(json.dumps(body),)], "b string").select(fn(F.col("b"))).first()[0] == url


def test_content_sniffing(spark):
    rows = [("application/pdf", b"x", ".pdf"), ("", b"%PDF-1.4", ".pdf"), ("text/html", b"a" * 511, None), ("text/html", b"a" * 512, ".html"), ("text/xml", b"a" * 600, ".xml"), ("image/png", b"a" * 600, None), ("application/pdf", b"", None)]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b, _ in rows], "t string, c binary")
    assert [r[0] for r in df.select(file_suffix(F.col("t"), F.col("c"))).collect()] == [s for *_, s in rows]


def recorded(url, headers, EPMC=EPMC):
    """Recorded answers: no network in tests."""
    if "europepmc" in url and "10.1000%2Fa" in url.replace("/a&", "%2Fa&"):
        return 200, "application/json", json.dumps(EPMC).encode()
    if "unpaywall" in url and "10.1000/b" in url:
        return 200, "application/json", json.dumps({"is_oa": True, "best_oa_location": {"url": "https://x/b"}}).encode()
    if url == "https://x/a.pdf":
        return 200, "application/pdf", b"%PDF-1.4 a"
    if url == "https://x/b":
        return 200, "text/html", b"<p>" + b"b" * 600
    if "crossref" in url:
        raise OSError("down")
    return 404, "", b""


def test_fetch_cascade(spark, tmp_path):
    dois = spark.createDataFrame([("10.1000/a",), ("10.1000/b",), ("10.1000/c",)], "doi string")
    got = {r["doi"]: r for r in fetch_all(dois, str(tmp_path / "cache"), get=recorded).collect()}
    assert got["10.1000/a"]["path"].endswith("10.1000_a.pdf") and (tmp_path / "cache/10.1000_a.pdf").read_bytes() == b"%PDF-1.4 a"
    assert got["10.1000/b"]["path"].endswith(".html") and len(got["10.1000/b"]["attempts"]) == 1
    assert got["10.1000/c"]["path"] is None and "OSError" in got["10.1000/c"]["attempts"][2]


def test_fetch_single(spark, tmp_path, monkeypatch):
    here = tmp_path / "x.pdf"
    here.write_bytes(b"1")
    assert fetch(spark, str(here), str(tmp_path)) == str(here)
    for wrong in ("", "not a doi"):
        with pytest.raises(FetchBlocked):
            fetch(spark, wrong, str(tmp_path))
    monkeypatch.setenv("SCRAPER_CONTACT", " me@x.org ")
    assert contact_address() == "me@x.org" and contact_address("you@x.org") == "you@x.org"


def test_recipe_defaults_and_paths(tmp_path):
    r = R.resolve({})
    assert (r.search.rrf_k, r.search.top_k, r.search.routing_enabled, r.search.global_top_k) == (60, 8, False, 20)
    assert (r.evaluation.top_k, r.graph.budget_concepts, r.graph.max_node_degree) == (10, 200, None)
    assert R.resolve({"retrieve": {"top_k": 5}}).evaluation.top_k == 5
    r = R.resolve({"retrieve": {"routing": {"enabled": True}}, "graph": {"max_node_degree": "7", "seed_concepts": ["a"]}})
    assert r.search.routing_enabled and r.graph.max_node_degree == 7 and r.graph.seed_concepts == ("a",)
    with pytest.raises(FileNotFoundError):
        R.load(tmp_path / "none.yaml")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r.yaml").write_text("graph: {path: g}\n")
    opened = R.open_recipe(tmp_path / "sub" / "r.yaml")
    assert opened.resolve(opened.graph.path) == str(tmp_path / "sub" / "g") and opened.resolve("/abs") == "/abs"


def test_command_line_usage(capsys):
    assert main([]) == 2 and main(["ingest"]) == 2 and main(["score"]) == 2
    assert "usage" in capsys.readouterr().out


def test_chunk_stream_lands_valid_rows_once(spark, outputs):
    (outputs / "d2" / "chunks.jsonl").write_text(json.dumps(line(1, "d2", kind="weird")) + "\n{broken\n" + json.dumps(line(2, "d2")) + "\n")
    table, log = str(outputs.parent / "landed"), str(outputs.parent / "log")
    for _ in range(2):
        land_chunks(chunk_stream(spark, str(outputs)), table, log).awaitTermination()
    assert sorted(r["chunk_id"] for r in landed_chunks(spark, table).collect()) == ["d1-c1", "d1-c2", "d2-c2"]
    assert [r["violation"] for r in spark.read.parquet(table).filter('violation IS NOT NULL').collect()] == ["invalid kind"]


def test_fields_of_other_types_keep_their_row(spark, outputs):
    odd = [
        {"page": "2"}, {"page": "ii"}, {"page": 3.0}, {"section_path": "Intro"}, {"text": 7}, {"page": None, "caption": ["a"]}, {"page": {"n": 1}},
    ]
    rows = [json.dumps({**line(i), **extra}) for i, extra in enumerate(odd)]
    (outputs / "d1" / "chunks.jsonl").write_text("\n".join([*rows, "  ", "[1, 2]", '"text"', "12", "{broken", "null"]) + "\n")
    (outputs / "d2" / "chunks.jsonl").write_text("")
    for scan in (P.scan_chunks, P.latest_chunks):
        got = {r["chunk_id"]: r for r in scan(spark, str(outputs)).collect()}
        assert len(got) == len(odd)
        pages = [got[f"d1-c{i}"]["page"] for i in range(len(odd))]
        assert pages[:3] == [2, None, 3] and pages[5:] == [None, None]
        assert got["d1-c3"]["section_path"] is None and got["d1-c4"]["text"] == "7"
    (outputs / "d1" / "chunks.jsonl").write_text("\n".join(rows) + "\n")
    assert P.scan_chunks_strict(spark, str(outputs)).count() == len(odd)


def test_places_far_into_a_file_stay_in_order(spark):
    place = "struct<file:string,block:bigint,position:bigint>"
    rows = [("x", ("f", (1 << 34) + 5, 3), "late"), ("x", ("f", 1 << 30, 9), "early"), ("x", ("e", 1 << 40, 99), "other file")]
    df = spark.createDataFrame(rows, f"chunk_id string, _place {place}, text string")
    assert df.selectExpr("max_by(text, _place)").first()[0] == "late"


def test_metadata_and_gold_with_odd_fields(spark, outputs, tmp_path):
    (outputs / "d2" / "document.meta.json").write_text(json.dumps({"id": "d2", "source": "html", "n_chunks": "3", "n_tables": [1], "errors": "none", "source_signals": 5}))
    meta = {r["id"]: r for r in P.scan_meta(spark, str(outputs)).collect()}
    assert meta["d2"]["n_chunks"] == 3 and meta["d2"]["n_tables"] is None and meta["d2"]["errors"] is None and meta["d2"]["slug"] == "d2"
    (tmp_path / "g.json").write_text(json.dumps({"items": [{"id": 1, "gold_chunk_ids": "a", "answerable": "maybe"}, {"id": "2", "gold_chunk_ids": ["a", "b"], "answerable": True}]}))
    gold = {r["id"]: r for r in P.scan_gold(spark, str(tmp_path / "g.json")).collect()}
    assert gold["1"]["gold_chunk_ids"] is None and gold["2"]["gold_chunk_ids"] == ["a", "b"] and gold["2"]["answerable"] is True
