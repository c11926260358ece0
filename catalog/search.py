"""Text statistics and retrieval queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quarrylight.contracts import audit_chunks
from quarrylight.functions import fixed, text as tx
from quarrylight.operators import semantic
from quarrylight.operators.dense import dense_topk
from quarrylight.operators.embed import embed
from quarrylight.plans.search import hits, hybrid_search, plan_widths, pruning_report, sparse_arm
from quarrylight.recipe import SearchSettings
from quarrylight.session import spread
from quarrylight.sources import corpus

from . import sqltext as S
from .workspace import benchmark_batch, chunks, index, once, read

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("chunk_scan", S.with_(S.CHUNKS, select="""
SELECT chunk_id, doc_id, 'text' AS kind, lang, source, length(text)::INTEGER AS n_chars,
       NULL::VARCHAR AS violation FROM chunks"""))
def chunk_scan(spark, folder):
    return audit_chunks(chunks(spark, folder)).select(
        "chunk_id", "doc_id", "kind",
        F.col("section_path")[0].alias("lang"), F.col("section_path")[1].alias("source"),
        F.length("text").alias("n_chars"), "violation",
    )


@query("chunk_contract", """
WITH raw AS (
  SELECT 'd' || doc_id AS doc_id, 'd' || doc_id || '-l' || pos AS chunk_id, trim(line) AS text,
         CASE WHEN starts_with(line, 'Th') THEN 'table' WHEN pos > 20 THEN 'note' ELSE 'text' END AS kind
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
SELECT violation, count(*) AS n FROM (
  SELECT CASE WHEN kind NOT IN ('text', 'table', 'figure', 'formula') THEN 'invalid kind'
              WHEN kind = 'text' AND text = '' THEN 'text chunk has no text'
              WHEN kind <> 'text' THEN 'missing artifact_id' END AS violation FROM raw)
GROUP BY 1""")
def chunk_contract(spark, folder):
    lines = read(spark, folder, "documents").select(
        corpus.doc_slug().alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    raw = lines.select(
        F.concat("doc_id", F.lit("-l"), (F.col("pos") + 1).cast("string")).alias("chunk_id"),
        "doc_id",
        F.trim("line").alias("text"),
        F.when(F.col("line").startswith("Th"), "table").when(F.col("pos") >= 20, "note")
        .otherwise("text").alias("kind"),
        F.lit(None).cast("string").alias("artifact_id"),
    )
    return audit_chunks(raw).groupBy("violation").agg(F.count("*").alias("n"))


@query("keywords_top5", S.with_(
    S.tf("documents", "doc_id", "text", "dtf"), S.keywords("dtf", "doc_id", "kw"),
    select="SELECT doc_id, kw_rank::INTEGER AS kw_rank, term FROM kw WHERE kw_rank <= 5"))
def keywords_top5(spark, folder):
    docs = tx.with_keywords(spread(read(spark, folder, "documents").select("doc_id", "text")), "text", 5)
    return (
        docs.select("doc_id", F.posexplode_outer("keywords").alias("pos", "term"))
        .filter(F.col("term").isNotNull())
        .select("doc_id", (F.col("pos") + 1).alias("kw_rank"), "term")
    )


KW = S.CHUNKS + "," + S.tf("chunks", "chunk_id", "text", "ctf") + "," + S.keywords("ctf", "chunk_id", "kw")


@query("term_index", "WITH " + KW + """
SELECT term, chunk_id FROM kw WHERE kw_rank <= 12""")
def term_index(spark, folder):
    return index(spark, folder).keywords.select("term", "chunk_id")


@query("doc_freq", "WITH " + KW + """
SELECT term, count(DISTINCT chunk_id) AS df FROM kw WHERE kw_rank <= 12 GROUP BY 1""")
def doc_freq(spark, folder):
    return index(spark, folder).keywords.groupBy("term").agg(
        F.count_distinct("chunk_id").alias("df")
    )


@query("postings", S.with_(S.CHUNK_INDEX, select="""
SELECT term, chunk_id, n::INTEGER AS tf, dl::INTEGER AS dl FROM ctf JOIN dl USING (chunk_id)"""))
def postings(spark, folder):
    return index(spark, folder).postings


@query("index_summary", S.with_(S.CHUNK_INDEX, select="""
SELECT (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(DISTINCT doc_id) FROM chunks) AS n_docs,
       (SELECT sum(n)::BIGINT FROM ctf) AS n_tokens, (SELECT count(*) FROM df) AS n_terms,
       (SELECT count(*) FROM ctf) AS n_postings"""))
def index_summary(spark, folder):
    ix = index(spark, folder)
    terms = ix.table("term_stats").agg(
        F.count("*").alias("n_terms"), F.sum("df").alias("n_postings")
    )
    return ix.table("stats").select("*", *[terms.select(c).scalar().alias(c) for c in terms.columns])


@query("chunk_vectors", S.with_(S.CHUNK_INDEX, select="""
SELECT chunk_id, b::INTEGER AS dim, round(w, 6) AS weight FROM cvec WHERE w <> 0"""))
def chunk_vectors(spark, folder):
    return (
        index(spark, folder).table("vectors")
        .select("chunk_id", F.posexplode("vector").alias("dim", "w"))
        .filter(F.col("w") != 0)
        .select("chunk_id", "dim", F.round(F.col("w").cast("double"), 6).alias("weight"))
    )


@query("bm25_topk", S.with_(
    S.CHUNK_INDEX, S.BENCH_Q, S.search_tf("q", "query_id", "question", "qtf"),
    "b_t AS (SELECT query_id, term FROM qtf)", S.sparse("q", "b", "20"),
    select="SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM b"))
def bm25_topk(spark, folder):
    return sparse_arm(index(spark, folder), benchmark_batch(spark, folder), 20)


@query("bm25_pruning", S.with_(
    S.CHUNK_INDEX, S.BENCH_Q, S.search_tf("q", "query_id", "question", "qtf"),
    select="SELECT query_id, sum(df)::BIGINT AS postings, true AS within FROM qtf JOIN df USING (term) GROUP BY 1"))
def bm25_pruning(spark, folder):
    """Postings of each query's words, and that no more of them were opened by the search for its best 20 chunks."""
    report = pruning_report(index(spark, folder), benchmark_batch(spark, folder), 20)
    within = (F.col("postings_read") <= F.col("postings")) & (F.col("blocks_read") <= F.col("blocks"))
    return report.select("query_id", "postings", within.alias("within"))


@query("dense_topk", S.with_(
    S.CHUNK_INDEX, S.BENCH_Q, S.search_tf("q", "query_id", "question", "qtf"),
    S.vectors("qtf", "query_id", "d_v"), S.dense("q", "d", "20"),
    select="SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM d"))
def dense_text_topk(spark, folder):
    ix, batch = index(spark, folder), benchmark_batch(spark, folder)
    return dense_topk(ix.table("vectors"), embed(batch.frame, "question"), 20)


LABEL_CENTROIDS = """
comp AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cent AS (SELECT label, i, avg(x) AS m FROM comp GROUP BY 1, 2),
cent_n AS (SELECT label, i, (m / sqrt(sum(m * m) OVER (PARTITION BY label)))::FLOAT::DOUBLE AS m FROM cent)"""


@query("tfidf_weights", S.with_(S.CHUNK_INDEX, f"""
n AS (SELECT count(*) AS n FROM chunks),
voc AS (SELECT term, df FROM df, n WHERE df >= {semantic.MIN_DF} AND df < n ORDER BY df DESC, term LIMIT {semantic.VOCABULARY}),
raw AS (SELECT chunk_id, term, (1 + ln(ctf.n)) * ln((n.n + 1)::DOUBLE / (df + 1)) AS w FROM ctf JOIN voc USING (term), n)""", select="""
SELECT chunk_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)), 6) AS weight FROM raw"""))
def tfidf_weights(spark, folder):
    """The matrix that semantic vectors are fitted on."""
    ix = index(spark, folder)
    words = semantic.vocabulary(ix.table("term_stats"), ix.stats["n_chunks"])
    found = semantic.tfidf(ix.table("terms"), words, ix.stats["n_chunks"])
    return found.select("chunk_id", "term", F.round("weight", 6).alias("weight"))


def semantics(spark, folder):
    def make():
        ix = index(spark, folder)
        return semantic.fit(ix.table("terms"), ix.table("term_stats"), ix.stats["n_chunks"])

    return once(spark, folder, "semantics", make)


@query("semantic_topk")
def semantic_topk(spark, folder):
    """Nearest chunks of all benchmark passages in the fitted space."""
    ix, batch, found = index(spark, folder), benchmark_batch(spark, folder), semantics(spark, folder)
    items = found.of_counted(ix.table("terms"))
    return dense_topk(items, found.of_texts(batch.frame, "query_id", "question"), 20)


@query("knn_topk", "WITH " + LABEL_CENTROIDS + """,
s AS (SELECT c.label, vec_id::VARCHAR AS item, round(sum(c.m * e.x), 6) + 0.0 AS score
      FROM cent_n c JOIN comp e USING (i) GROUP BY 1, 2)
SELECT 'l' || label AS query_id, rank::INTEGER AS rank, item, score FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, item) AS rank FROM s) WHERE rank <= 10""")
def knn_topk(spark, folder):
    from quarrylight.operators.centroids import centroids

    emb = read(spark, folder, "embeddings")
    probes = centroids(emb, "label", "embedding").select(
        F.concat(F.lit("l"), F.col("label").cast("string")).alias("query_id"),
        F.col("centroid").alias("vector"),
    )
    items = emb.select(F.col("vec_id").cast("string").alias("item"), F.col("embedding").alias("vector"))
    return dense_topk(items, probes, 10, item="item")


@query("hybrid_rrf", S.with_(S.CHUNK_INDEX, S.BENCH_Q, S.hybrid("q", "h", "40"), select="""
SELECT query_id, rank::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM h WHERE rank <= 10"""))
def hybrid_rrf(spark, folder):
    found = hybrid_search(index(spark, folder), benchmark_batch(spark, folder), top_k=10)
    return found.withColumn("score", F.round("score", 6))


@query("search_hits", S.with_(S.CHUNK_INDEX, S.BENCH_Q, S.hybrid("q", "h", "32"), select="""
SELECT query_id, rank::INTEGER AS rank, chunk_id, doc_id, 'text' AS kind, lang, source, 1 AS page,
       NULL::VARCHAR AS artifact_id, text
FROM (SELECT * FROM h WHERE rank <= 8) JOIN chunks USING (chunk_id)"""))
def hits_query(spark, folder):
    ix, batch = index(spark, folder), benchmark_batch(spark, folder)
    found = hits(hybrid_search(ix, batch, top_k=8), ix.chunks, batch.rows * 8)
    return found.select(
        "query_id", "rank", "citation.chunk_id", "citation.doc_id", "chunk.kind",
        F.col("citation.section_path")[0].alias("lang"),
        F.col("citation.section_path")[1].alias("source"),
        "citation.page", "citation.artifact_id", "chunk.text",
    )


def marker_count(markers) -> str:
    return " + ".join(f"contains(p, '{m}')::INTEGER" for m in markers)


@query("route_lexical", f"""
WITH t AS (SELECT 'v-' || conv_id || '-' || turn AS query_id, text FROM conversations
           UNION ALL SELECT 'b' || item_id, text FROM benchmark
           UNION ALL SELECT 'd' || doc_id, text FROM documents),
m AS (SELECT query_id, ({marker_count(fixed.GLOBAL_MARKERS)}) - ({marker_count(fixed.LOCAL_MARKERS)}) AS lead
      FROM (SELECT query_id, ' ' || lower(text) || ' ' AS p FROM t))
SELECT query_id, CASE WHEN lead > 0 THEN 'global' ELSE 'local' END AS scope, abs(lead)::INTEGER AS strength FROM m""")
def route_lexical(spark, folder):
    texts = (
        corpus.conversation_queries(read(spark, folder, "conversations"))
        .unionByName(corpus.benchmark_queries(read(spark, folder, "benchmark")))
        .unionByName(
            read(spark, folder, "documents").select(
                corpus.doc_slug().alias("query_id"), F.col("text").alias("question")
            )
        )
    )
    return texts.select("query_id", tx.lexical_scope(F.col("question")).alias("s")).select(
        "query_id", "s.scope", "s.strength"
    )


@query("route_exemplar", "WITH " + LABEL_CENTROIDS + """,
s AS (SELECT e.vec_id, c.label, sum(c.m * e.x) / (sqrt(sum(c.m * c.m)) * sqrt(sum(e.x * e.x))) AS cos
      FROM cent_n c JOIN comp e USING (i) GROUP BY 1, 2),
m AS (SELECT vec_id, max(cos) FILTER (label < 5) AS l, max(cos) FILTER (label >= 5) AS g FROM s GROUP BY 1)
SELECT vec_id, CASE WHEN abs(g - l) >= 0.03 AND g > l THEN 'global' ELSE 'local' END AS scope,
       CASE WHEN abs(g - l) >= 0.03 THEN 'exemplar' ELSE 'lexical' END AS method,
       CASE WHEN abs(g - l) >= 0.03 THEN round(g - l, 4) ELSE 0.0 END AS route_score FROM m""")
def route_exemplar(spark, folder):
    from quarrylight.operators.centroids import centroids
    from quarrylight.operators.router import decide_scope, exemplar_similarity

    emb = read(spark, folder, "embeddings")
    # One centroid per label; the label set is the fixed exemplar list of this query.
    sides = centroids(emb, "label", "embedding").orderBy("label").toPandas()
    pick = lambda keep: np.stack(sides["centroid"][keep(sides["label"])])
    near = exemplar_similarity(
        emb.select("vec_id", F.col("embedding").alias("vector")), "vector",
        pick(lambda x: x < 5), pick(lambda x: x >= 5),
    )
    return decide_scope(near.withColumn("question", F.lit("")), "question", 0.03).select(
        "vec_id", "scope", "method", "route_score"
    )


def exemplar_rows(side: str, texts) -> str:
    return ", ".join(f"('{side}', {i}, '{t}')" for i, t in enumerate(texts))


ROUTED = ",".join([
    f"""
ex(side, no, text) AS (VALUES {exemplar_rows('local', fixed.LOCAL_EXEMPLARS)},
                              {exemplar_rows('global', fixed.GLOBAL_EXEMPLARS)}),
exk AS (SELECT side || no AS ek, text FROM ex)""",
    S.search_tf("exk", "ek", "text", "etf"), S.vectors("etf", "ek", "ev"),
    S.search_tf("q0", "query_id", "question", "q0tf"), S.vectors("q0tf", "query_id", "q0v"),
    f"""
sim AS (SELECT query_id, ek, coalesce(sum(v.w * e.w), 0) AS s
        FROM (SELECT query_id, ek FROM q0, exk) LEFT JOIN q0v v USING (query_id)
             LEFT JOIN ev e USING (ek, b) GROUP BY 1, 2),
lead AS (SELECT query_id, max(s) FILTER (ek LIKE 'g%') - max(s) FILTER (ek LIKE 'l%') AS d FROM sim GROUP BY 1),
lex AS (SELECT query_id, ({marker_count(fixed.GLOBAL_MARKERS)}) - ({marker_count(fixed.LOCAL_MARKERS)}) AS lead
        FROM (SELECT query_id, ' ' || lower(question) || ' ' AS p FROM q0)),
route AS (SELECT query_id, question,
            CASE WHEN abs(d) >= 0.03 THEN CASE WHEN d > 0 THEN 'global' ELSE 'local' END
                 WHEN lead > 0 THEN 'global' ELSE 'local' END AS scope,
            CASE WHEN abs(d) >= 0.03 THEN 'exemplar' ELSE 'lexical' END AS method,
            CASE WHEN abs(d) >= 0.03 THEN round(d, 4) ELSE abs(lead)::DOUBLE END AS route_score
          FROM q0 JOIN lead USING (query_id) JOIN lex USING (query_id))""",
])


@query("routed_search", S.with_(
    S.CHUNK_INDEX, S.BENCH_Q.replace("q AS", "q0 AS"), ROUTED,
    """
q AS (SELECT query_id, question, CASE WHEN scope = 'global' THEN 60 ELSE 32 END AS candidate_k,
             CASE WHEN scope = 'global' THEN 20 ELSE 8 END AS top_k FROM route)""",
    S.hybrid("q", "h", "candidate_k"),
    select="""
SELECT query_id, rank::INTEGER AS rank, chunk_id, scope, method, route_score, candidate_k, top_k
FROM h JOIN q USING (query_id) JOIN route USING (query_id) WHERE rank <= top_k"""))
def routed_search(spark, folder):
    ix, batch = index(spark, folder), benchmark_batch(spark, folder)
    planned = plan_widths(ix, batch, SearchSettings(), route=True)
    facts = planned[0].select("query_id", "scope", "method", "route_score", "candidate_k", "top_k")
    return hybrid_search(ix, batch, route=True, planned=planned).join(facts, "query_id").drop("score")
