"""Reranking, caller-written sub-queries, metadata, registry answers and page geometry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrylight.functions import fixed
from quarrylight.operators import artifacts as A
from quarrylight.operators import classify as CL
from quarrylight.plans.multi import multi_query_search
from quarrylight.plans.search import hybrid_search
from quarrylight.recipe import SearchSettings
from quarrylight.session import spread
from quarrylight.sources import products as P
from quarrylight.sources.responses import RENDER_URL, crossref_url, europepmc_url, file_suffix, unpaywall_url

from . import sqltext as S
from .evaluate import list_ctes, shift
from .workspace import benchmark_batch, index, read

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("rerank_overlap", S.with_(
    S.CHUNK_INDEX, S.BENCH_Q, S.hybrid("q", "h", "32"),
    """
asked AS (SELECT query_id, count(*) AS n FROM h_qtf GROUP BY 1),
shared AS (SELECT h.query_id, h.chunk_id, h.rank, count(c.term) AS s FROM h
           LEFT JOIN h_qtf t ON t.query_id = h.query_id LEFT JOIN ctf c ON c.chunk_id = h.chunk_id AND c.term = t.term
           GROUP BY 1, 2, 3),
sc AS (SELECT query_id, chunk_id, rank AS old, coalesce(s / n::DOUBLE, 0) AS score FROM shared LEFT JOIN asked USING (query_id))""",
    select="""
SELECT query_id, rank::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM sc) WHERE rank <= 8"""))
def rerank_overlap(spark, folder):
    found = hybrid_search(
        index(spark, folder), benchmark_batch(spark, folder), SearchSettings(), top_k=8, rerank=True
    )
    return found.withColumn("score", F.round("score", 6))


@query("given_subqueries", S.with_(
    S.CHUNK_INDEX, S.BENCH_Q,
    """
subs AS (SELECT query_id, 0 AS list_no, question FROM q
         UNION ALL SELECT query_id, i, l FROM (
           SELECT query_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
           FROM (SELECT query_id, string_split(question, chr(10)) AS ls FROM q)))""",
    list_ctes("subs", "g", 16), S.rrf([shift("glists")], "f"),
    select="SELECT query_id, rank::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM f WHERE rank <= 8"))
def given_subqueries(spark, folder):
    """Each line of a passage stands for a caller-written question."""
    batch = benchmark_batch(spark, folder)
    extra = batch.frame.select("query_id", F.posexplode(F.split("question", "\n")).alias("pos", "question"))
    return multi_query_search(index(spark, folder), batch, extra=extra)


META = """
meta AS (SELECT 'd' || doc_id || '-' || (1990 + doc_id % 40) AS id,
                CASE quality WHEN 1 THEN 'pdf-native' WHEN 0 THEN CASE WHEN toxic = 1 THEN 'pdf-scan-image' ELSE 'pdf-scan-ocr' END ELSE 'html' END AS source,
                len(string_split(text, chr(10)))::INTEGER AS n_chunks, CASE WHEN contains(text, ' | ') THEN 1 ELSE 0 END AS n_tables,
                CASE WHEN lang = 'en' THEN NULL ELSE 2 END AS n_formulas
         FROM documents LEFT JOIN labels USING (doc_id))"""


def meta(spark, folder):
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    scan = F.when(F.col("toxic") == 1, "pdf-scan-image").otherwise("pdf-scan-ocr")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), (1990 + F.col("doc_id") % 40).cast("string")).alias("id"),
        F.when(F.col("quality") == 1, "pdf-native").when(F.col("quality") == 0, scan).otherwise("html").alias("source"),
        F.lit(None).cast("double").alias("source_confidence"),
        F.size(F.split("text", "\n")).alias("n_chunks"),
        F.col("text").contains(" | ").cast("int").alias("n_tables"),
        F.lit(0).alias("n_figures"),
        F.when(F.col("lang") != "en", 2).alias("n_formulas"),
        F.lit("").alias("slug"),
    )


@query("list_documents", "WITH " + META + """
SELECT id, source, n_chunks, n_tables, 0 AS n_figures, n_formulas FROM meta""")
def list_documents(spark, folder):
    return P.list_documents(meta(spark, folder)).drop("source_confidence")


@query("document_sources", "WITH " + META + """
SELECT id AS doc_id, CASE WHEN source = 'pdf-native' THEN 'native' WHEN source LIKE 'pdf-scan%' THEN 'scan' ELSE 'unknown' END AS doc_class FROM meta""")
def document_sources(spark, folder):
    return P.document_sources(meta(spark, folder))


@query("document_features", "WITH " + META + r"""
SELECT id AS doc_id, CASE WHEN source = 'pdf-native' THEN 'native' ELSE 'scan' END AS source,
       nullif(regexp_extract(id, '((?:19|20)\d{2})', 1), '')::INTEGER AS year, n_chunks,
       n_tables > 0 AS has_tables, coalesce(n_formulas, 0) > 0 AS has_formulas FROM meta""")
def document_features(spark, folder):
    return P.document_features(meta(spark, folder))


@query("indexable_text", """
SELECT o_orderkey, coalesce(nullif(CASE o_orderstatus WHEN 'O' THEN o_orderpriority WHEN 'F' THEN '' END, ''),
       CASE WHEN o_orderkey % 3 = 0 THEN 'caption ' || o_custkey END, CASE WHEN o_orderkey % 5 = 0 THEN 'label' END,
       CASE WHEN o_orderkey % 7 = 0 THEN 'title' END,
       'table ' || CASE WHEN o_orderkey % 2 = 0 THEN 't' || o_orderkey ELSE 'o' || o_orderkey END) AS text FROM orders""")
def indexable_text(spark, folder):
    k = F.col("o_orderkey")
    rows = read(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "F", "").alias("text"),
        F.when(k % 3 == 0, F.concat(F.lit("caption "), F.col("o_custkey").cast("string"))).alias("caption"),
        F.when(k % 5 == 0, "label").alias("label"), F.when(k % 7 == 0, "title").alias("title"),
        F.lit("table").alias("kind"), F.concat(F.lit("o"), k.cast("string")).alias("chunk_id"),
        F.when(k % 2 == 0, F.concat(F.lit("t"), k.cast("string"))).otherwise("").alias("artifact_id"),
    )
    return rows.select("o_orderkey", P.indexable_text().alias("text"))


@query("registry_links", f"""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)
SELECT k, CASE WHEN s <> 'F' AND k % 2 = 0 THEN 'https://x/' || k || '.pdf'
               WHEN s <> 'F' AND k % 3 = 0 THEN '{RENDER_URL.split("%s")[0]}PMC' || k || '{RENDER_URL.split("%s")[1]}' END AS europepmc,
       CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'best.pdf' WHEN k % 7 = 0 THEN 'page' WHEN k % 3 = 0 THEN 'other.pdf' END END AS unpaywall,
       CASE WHEN k % 6 = 0 THEN 'https://y/typed' WHEN k % 5 = 0 THEN 'https://y/' || k || '.PDF' END AS crossref,
       CASE WHEN k % 3 = 0 THEN '.pdf' WHEN k % 3 = 1 AND k % 2 = 0 THEN '.html' END AS suffix FROM o""")
def registry_links(spark, folder):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    name = k.cast("string")
    link = lambda url, style, access: F.struct(
        url.alias("url"), F.lit(style).alias("documentStyle"), access.alias("availability")
    )
    result = F.struct(
        F.concat(F.lit("PMC"), name).alias("pmcid"),
        F.when(k % 3 == 0, "Y").otherwise("N").alias("isOpenAccess"),
        F.struct(
            F.array(
                link(F.lit("https://x/page"), "html", F.lit("Free")),
                link(F.concat(F.lit("https://x/"), name, F.lit(".pdf")), "pdf",
                     F.when(k % 2 == 0, "Open access").otherwise("Subscription required")),
            ).alias("fullTextUrl")
        ).alias("fullTextUrlList"),
    )
    answered = F.array(result)
    europe = F.to_json(F.struct(F.struct(F.when(s != "F", answered).alias("result")).alias("resultList")))
    place = lambda pdf, url: F.struct(pdf.alias("url_for_pdf"), url.alias("url"))
    unpaywall = F.to_json(
        F.struct(
            (k % 4 != 0).alias("is_oa"),
            place(F.when(k % 5 == 0, "best.pdf"), F.when(k % 7 == 0, "page")).alias("best_oa_location"),
            F.array(
                place(F.lit(None).cast("string"), F.lit("landing")), place(F.when(k % 3 == 0, "other.pdf"), F.lit("x"))
            ).alias("oa_locations"),
        )
    )
    typed = F.struct(F.lit("https://y/typed").alias("URL"),
                     F.when(k % 6 == 0, "application/pdf").otherwise("text/html").alias("content-type"))
    named = F.struct(
        F.concat(F.lit("https://y/"), name, F.when(k % 5 == 0, ".PDF").otherwise(".html")).alias("URL"),
        F.lit("unspecified").alias("content-type"),
    )
    crossref = F.to_json(F.struct(F.struct(F.array(named, typed).alias("link")).alias("message")))
    kind = F.when(k % 3 == 1, "text/html; charset=utf-8").otherwise("image/png")
    body = F.when(k % 3 == 0, F.lit("%PDF-1.7")).otherwise(F.repeat(F.lit("x"), F.when(k % 2 == 0, 512).otherwise(511)))
    return read(spark, folder, "orders").select(
        k.alias("k"), europepmc_url(europe).alias("europepmc"), unpaywall_url(unpaywall).alias("unpaywall"),
        crossref_url(crossref).alias("crossref"), file_suffix(kind, body.cast("binary")).alias("suffix"),
    )


# Order lines stand for layout boxes on 430 by 430 pages.
BOXES = """
b AS (SELECT 'o' || l_orderkey AS doc_id, (l_suppkey % 2)::INTEGER AS page,
             (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity))::INTEGER AS no,
             l_quantity * 7 AS x0, l_quantity * 7 + (l_partkey % 90) AS x1, 0.0::DOUBLE AS y0, 150.0::DOUBLE AS y1 FROM lineitem),
p AS (SELECT DISTINCT doc_id, page FROM b)"""


def line_boxes(spark, folder):
    lines = spread(read(spark, folder, "lineitem"))
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    x0 = F.col("l_quantity") * 7
    box = lines.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("doc_id"),
        (F.col("l_suppkey") % 2).cast("int").alias("page"),
        F.row_number().over(order).alias("no"),
        x0.alias("x0"), (x0 + F.col("l_partkey") % 90).alias("x1"),
        F.lit(0.0).alias("y0"), F.lit(150.0).alias("y1"),
    )
    pages = box.select("doc_id", "page").distinct().withColumns({"width": F.lit(430.0), "height": F.lit(430.0)})
    return box, pages


@query("image_coverage", "WITH " + BOXES + """
SELECT p.doc_id, p.page, round(greatest(0, least(1, coalesce(sum(abs((x1 - x0) * (y1 - y0))), 0) / 184900)), 6) AS coverage
FROM p LEFT JOIN b ON b.doc_id = p.doc_id AND b.page = p.page AND b.no % 2 = 1 GROUP BY 1, 2""")
def image_coverage(spark, folder):
    box, pages = line_boxes(spark, folder)
    return CL.image_coverage(box.filter("no % 2 = 1"), pages).withColumn("coverage", F.round("coverage", 6))


@query("column_guess", "WITH " + BOXES + """
SELECT p.doc_id, p.page, CASE WHEN count(b.no) >= 4 AND count(*) FILTER (b.x0 / 430 > 0.5) >= greatest(2, count(b.no) // 4) THEN 2 ELSE 1 END AS col_guess
FROM p JOIN b USING (doc_id, page) GROUP BY 1, 2""")
def column_guess(spark, folder):
    box, pages = line_boxes(spark, folder)
    return CL.column_guess(box, pages)


@query("figure_artifacts", "WITH " + BOXES + f"""
SELECT doc_id, doc_id || '-f' || row_number() OVER (PARTITION BY doc_id ORDER BY page, no) AS id, page,
       round(x0, 2) AS x0, round(x1, 2) AS x1, false AS has_caption, '' AS caption
FROM b WHERE abs((x1 - x0) * (y1 - y0)) >= {fixed.MIN_FIGURE_AREA}""")
def figure_artifacts(spark, folder):
    box, _ = line_boxes(spark, folder)
    text = box.select("doc_id", "page", F.col("no").alias("block_no"), "x0", "y0", "x1", "y1", F.lit("no caption").alias("text"))
    found = A.extract_figures(box.withColumnRenamed("no", "object_no"), text)
    return found.select("doc_id", "id", "page", F.col("bbox")[0].alias("x0"), F.col("bbox")[2].alias("x1"), "has_caption", "caption")


@query("table_artifacts", """
WITH g AS (SELECT o_custkey, o_orderstatus AS st, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY no) AS n FROM g WHERE st <> 'F')
SELECT 'c' || o_custkey AS doc_id, 'c' || o_custkey || '-t' || n AS id, 2 AS n_rows, 2 AS n_cols, 'key ' || o_orderkey AS first_cell, '' AS caption FROM k""")
def table_artifacts(spark, folder):
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    empty = F.col("o_orderstatus") == "F"
    head = F.concat(F.lit("key \n "), F.col("o_orderkey").cast("string"))
    blank = F.lit("  ")
    found = read(spark, folder, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_id"), F.lit(1).alias("page"),
        F.row_number().over(order).alias("object_no"),
        *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")],
        F.array(F.array(F.when(empty, blank).otherwise(head), blank), F.array(F.lit(None).cast("string"), blank)).alias("cells"),
        F.lit(None).cast("int").alias("n_rows"), F.lit(None).cast("int").alias("n_cols"),
    )
    text = found.select("doc_id", "page", F.col("object_no").alias("block_no"), "x0", "y0", "x1", "y1", F.lit("prose").alias("text"))
    return A.extract_tables(found, text).select(
        "doc_id", "id", "n_rows", "n_cols", F.col("cells")[0][0].alias("first_cell"), "caption"
    )
