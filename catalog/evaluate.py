"""Multi-query, feedback, probe and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.evaluation import experiments as X
from quarrylight.evaluation import metrics as M
from quarrylight.evaluation import probes as P
from quarrylight.functions import fixed
from quarrylight.operators.sparse import query_terms
from quarrylight.plans import evaluation as E
from quarrylight.plans.multi import feedback_search, multi_query_search, subqueries
from quarrylight.recipe import EvalSettings
from quarrylight.session import BROADCAST_ROWS, bounded_count, broadcast_within, spill
from quarrylight.sources import corpus

from . import sqltext as S
from .workspace import benchmark_batch, index, once, read

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


SUB_STOP = S.words(fixed.SUBQUERY_STOP + fixed.SCAFFOLD)


def sub_ctes(q: str, p: str, n_sub: int = 4) -> str:
    """Sub-queries of ``q``: ``{p}subs(query_id, list_no, question)``."""
    return S.tf(q, "query_id", "question", f"{p}stf", SUB_STOP) + "," + S.keywords(
        f"{p}stf", "query_id", f"{p}skw"
    ) + f""",
{p}subs AS (SELECT query_id, 0 AS list_no, question FROM {q}
         UNION ALL SELECT query_id, kw_rank, term FROM {p}skw WHERE kw_rank < {n_sub})"""


def list_ctes(subs: str, p: str, k: int) -> str:
    """Ranked lists of every sub-query: ``{p}lists(query_id, list_no, rank, chunk_id)``."""
    return f"""
{p}asks AS (SELECT md5(question) AS query_id, any_value(question) AS question FROM {subs} GROUP BY 1),{S.hybrid(f'{p}asks', f'{p}h', str(4 * k))},
{p}lists AS (SELECT s.query_id, s.list_no, h.rank, h.chunk_id
          FROM {subs} s JOIN {p}h h ON md5(s.question) = h.query_id WHERE h.rank <= {k})"""


def follow_ctes(q: str, fused: str, p: str, width: int, n_sub: int = 4) -> str:
    """Follow-up questions from the texts found: ``{p}follow(query_id, question)``."""
    return f"""
{p}seen AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS seen
         FROM {fused} JOIN chunks USING (chunk_id) WHERE rank <= {width} GROUP BY 1),{S.tf(f'{p}seen', 'query_id', 'seen', f'{p}ftf')},{S.keywords(f'{p}ftf', 'query_id', f'{p}fkw')},
{p}fw AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY kw_rank) AS r
       FROM {p}fkw WHERE kw_rank <= {2 * n_sub} AND term NOT IN ({S.words(fixed.SCAFFOLD)})),
{p}follow AS (SELECT q.query_id, coalesce(string_agg(term, ' ' ORDER BY r), any_value(q.question)) AS question
           FROM {q} q LEFT JOIN (SELECT * FROM {p}fw WHERE r <= {n_sub}) w USING (query_id) GROUP BY 1)"""


def shift(lists: str, by: int = 0) -> str:
    return f"SELECT query_id, list_no + {by} AS list_no, rank, chunk_id FROM {lists}"


@query("subqueries", S.with_(
    S.BENCH_Q, sub_ctes("q", "m"),
    select="SELECT query_id, list_no::INTEGER AS list_no, question FROM msubs"))
def subqueries_query(spark, folder):
    return subqueries(benchmark_batch(spark, folder).frame)


@query("multi_query", S.with_(
    S.CHUNK_INDEX, S.BENCH_Q, sub_ctes("q", "m"), list_ctes("msubs", "m", 16),
    S.rrf([shift("mlists")], "f"),
    select="SELECT query_id, rank::INTEGER AS rank, chunk_id, round(score, 6) AS score FROM f WHERE rank <= 8"))
def multi_query(spark, folder):
    return multi_query_search(index(spark, folder), benchmark_batch(spark, folder))


@query("feedback_rounds", S.with_(
    S.CHUNK_INDEX, S.BENCH_Q, "s0 AS (SELECT query_id, 0 AS list_no, question FROM q)",
    list_ctes("s0", "a", 20), S.rrf([shift("alists")], "f0"), follow_ctes("q", "f0", "w", 20),
    "s1 AS (SELECT query_id, 0 AS list_no, question FROM wfollow)",
    list_ctes("s1", "b", 20), S.rrf([shift("alists"), shift("blists", 5)], "f1"),
    select="SELECT query_id, rank::INTEGER AS rank, chunk_id FROM f1 WHERE rank <= 20"))
def feedback_rounds(spark, folder):
    return feedback_search(index(spark, folder), benchmark_batch(spark, folder), 20, feedback=True)


KW = S.tf("chunks", "chunk_id", "text", "ktf") + "," + S.keywords("ktf", "chunk_id", "kw")
N_LOCAL = 30


def probe_ctes(k: int) -> str:
    """``gold(id, scope, question, chunk_id, doc_id)`` and ``q(query_id, question)``."""
    return f"""
rr AS (SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS depth FROM chunks),
lp AS (SELECT 'local::' || chunk_id AS id, string_agg(term, ' ' ORDER BY kw_rank) AS question, chunk_id, doc_id
       FROM (SELECT chunk_id, doc_id FROM rr ORDER BY depth, doc_id LIMIT {N_LOCAL}) JOIN kw USING (chunk_id)
       WHERE kw_rank <= 5 GROUP BY chunk_id, doc_id HAVING count(*) >= 3),
gt AS (SELECT term, count(*) AS c FROM kw JOIN chunks USING (chunk_id) WHERE kw_rank <= 12 GROUP BY 1
       HAVING count(*) BETWEEN 2 AND {k} AND count(DISTINCT (doc_id, lang, source)) >= 2
       ORDER BY c DESC, term LIMIT {N_LOCAL}),
gold AS (SELECT id, 'local' AS scope, question, chunk_id, doc_id FROM lp
         UNION ALL SELECT 'global::' || term, 'global', '{fixed.GLOBAL_QUESTION_PREFIX}' || term, chunk_id, doc_id
         FROM gt JOIN kw USING (term) JOIN chunks USING (chunk_id) WHERE kw_rank <= 12)"""


PROBE_Q = "q AS (SELECT DISTINCT id AS query_id, question FROM gold)"


def scored_ctes(ranked: str, k: str, p: str = "") -> str:
    """``{p}per(id, scope, doc_class, n_gold, n_scan_gold, recall, hit, rr)``."""
    return f"""
{p}per AS (
  SELECT id, scope,
         CASE WHEN bool_or(c = 'scan') THEN 'scan' WHEN bool_and(c = 'native') THEN 'native' ELSE 'unknown' END AS doc_class,
         count(*) AS n_gold, count(*) FILTER (c = 'scan') AS n_scan_gold,
         count(rank)::DOUBLE / count(*) AS recall, CASE WHEN count(rank) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit,
         coalesce(1.0::DOUBLE / min(rank), 0) AS rr
  FROM (SELECT g.id, g.scope, r.rank,
               coalesce(CASE quality WHEN 1 THEN 'native' WHEN 0 THEN 'scan' END, 'unknown') AS c
        FROM gold g LEFT JOIN (SELECT * FROM {ranked} WHERE rank <= {k}) r
             ON g.id = r.query_id AND g.chunk_id = r.chunk_id
             LEFT JOIN labels l ON g.doc_id = 'd' || l.doc_id)
  GROUP BY id, scope),
{p}cells AS (
  SELECT g.scope, g.doc_class, count(p.id) AS n, round(avg(recall), 4) AS recall_at_k,
         round(avg(hit), 4) AS hit_rate, round(avg(rr), 4) AS mrr
  FROM (VALUES ('local', 'all'), ('local', 'native'), ('local', 'scan'),
               ('global', 'all'), ('global', 'native'), ('global', 'scan')) g(scope, doc_class)
  LEFT JOIN {p}per p ON p.scope = g.scope AND (g.doc_class = 'all' OR p.doc_class = g.doc_class)
  GROUP BY 1, 2)"""


@query("local_probes", S.with_(S.CHUNK_INDEX, KW, probe_ctes(10), select="""
SELECT DISTINCT id, question, scope, chunk_id AS gold, doc_id FROM gold WHERE scope = 'local'"""))
def local_probes(spark, folder):
    found = P.local_probes(index(spark, folder), N_LOCAL)
    return found.withColumn("gold", F.element_at("gold_chunk_ids", 1)).drop("gold_chunk_ids")


@query("global_probes", S.with_(S.CHUNK_INDEX, KW, probe_ctes(10), select="""
SELECT id, question, scope, string_agg(chunk_id, ',' ORDER BY chunk_id) AS gold FROM gold
WHERE scope = 'global' GROUP BY 1, 2, 3"""))
def global_probes(spark, folder):
    found = P.global_probes(index(spark, folder), N_LOCAL, 10)
    return found.select("id", "question", "scope", F.array_join("gold_chunk_ids", ",").alias("gold"))


HARD = """
kdf AS (SELECT term, count(*) AS kdf FROM kw WHERE kw_rank <= 12 GROUP BY 1),
rr AS (SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS depth FROM chunks),
hard AS (SELECT 'hardlocal::' || chunk_id AS id, string_agg(term, ' ' ORDER BY r) AS question, chunk_id, doc_id
         FROM (SELECT chunk_id, doc_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY kdf DESC, kw_rank) AS r
               FROM rr JOIN kw USING (chunk_id) JOIN kdf USING (term) WHERE depth <= 8 AND kw_rank <= 8)
         WHERE r <= 2 GROUP BY chunk_id, doc_id HAVING count(*) = 2)"""


@query("hard_local_probes", S.with_(S.CHUNK_INDEX, KW, HARD, select="""
SELECT id, question, chunk_id AS gold, doc_id FROM hard"""))
def hard_local_probes(spark, folder):
    found = P.hard_local_probes(index(spark, folder))
    return found.select("id", "question", F.element_at("gold_chunk_ids", 1).alias("gold"), "doc_id")


def sources(spark, folder):
    return corpus.label_sources(read(spark, folder, "labels"))


def run(spark, folder, route: bool) -> E.EvalRun:
    return once(
        spark, folder, f"eval-{route}",
        lambda: E.run_eval(index(spark, folder), sources(spark, folder), route=route),
    )


PLAIN_RUN = [S.CHUNK_INDEX, KW, probe_ctes(10), PROBE_Q, S.hybrid("q", "h", "40"), scored_ctes("h", "10")]


@query("eval_per_probe", S.with_(*PLAIN_RUN, select="""
SELECT id, scope, doc_class, n_gold::INTEGER AS n_gold, n_scan_gold, round(recall, 6) AS recall, hit,
       round(rr, 6) AS rr FROM per"""))
def eval_per_probe(spark, folder):
    per = run(spark, folder, False).per_probe
    return per.withColumns({"recall": F.round("recall", 6), "rr": F.round("rr", 6)})


@query("eval_strata", S.with_(*PLAIN_RUN, select="SELECT * FROM cells"))
def eval_strata(spark, folder):
    return run(spark, folder, False).cells


@query("decision", S.with_(*PLAIN_RUN, select="""
SELECT ln AS local_n, lr AS local_recall, gn AS global_n, gr AS global_recall,
  CASE WHEN ln = 0 OR lr IS NULL THEN 'INSUFFICIENT_DATA' WHEN lr < 0.6 THEN 'TUNE_RETRIEVAL_FIRST'
       WHEN gn = 0 OR gr IS NULL THEN 'HYBRID_SUFFICIENT' WHEN gr >= 0.7 THEN 'HYBRID_SUFFICIENT'
       WHEN round(lr - gr, 4) >= 0.25 THEN 'CONSIDER_GRAPH_OR_ROUTING' ELSE 'MONITOR' END AS decision,
  coalesce(nn >= 3 AND sn >= 3 AND nr - sr >= 0.25, false) AS stratum_note
FROM (SELECT max(n) FILTER (scope = 'local' AND doc_class = 'all') AS ln,
             max(recall_at_k) FILTER (scope = 'local' AND doc_class = 'all') AS lr,
             max(n) FILTER (scope = 'global' AND doc_class = 'all') AS gn,
             max(recall_at_k) FILTER (scope = 'global' AND doc_class = 'all') AS gr,
             max(n) FILTER (scope = 'global' AND doc_class = 'native') AS nn,
             max(recall_at_k) FILTER (scope = 'global' AND doc_class = 'native') AS nr,
             max(n) FILTER (scope = 'global' AND doc_class = 'scan') AS sn,
             max(recall_at_k) FILTER (scope = 'global' AND doc_class = 'scan') AS sr FROM cells)"""))
def decision(spark, folder):
    row = E.decide(run(spark, folder, False).cells, EvalSettings())
    return row.select(
        F.col("local_all_n").alias("local_n"), F.col("local_all_recall").alias("local_recall"),
        F.col("global_all_n").alias("global_n"), F.col("global_all_recall").alias("global_recall"),
        "decision", "stratum_note",
    )


def routed_run() -> list[str]:
    from .search import ROUTED

    return [
        S.CHUNK_INDEX, KW, probe_ctes(10), PROBE_Q, S.hybrid("q", "h", "40"), scored_ctes("h", "10", "off_"),
        "q0 AS (SELECT * FROM q)", ROUTED,
        """
qr AS (SELECT query_id, question, CASE WHEN scope = 'global' THEN 60 ELSE 32 END AS candidate_k,
             CASE WHEN scope = 'global' THEN 20 ELSE 8 END AS top_k FROM route)""",
        S.hybrid("qr", "hr", "candidate_k"),
        "hk AS (SELECT hr.* FROM hr JOIN qr USING (query_id) WHERE rank <= top_k)",
        scored_ctes("hk", "1000", "on_"),
    ]


@query("routing_delta", S.with_(*routed_run(), select="""
SELECT scope, doc_class, a.recall_at_k AS recall_off, b.recall_at_k AS recall_on,
       round(coalesce(b.recall_at_k, 0) - coalesce(a.recall_at_k, 0), 4) AS delta
FROM off_cells a JOIN on_cells b USING (scope, doc_class)"""))
def routing_delta(spark, folder):
    return E.compare_routing(run(spark, folder, False), run(spark, folder, True))


@query("recall_by_kind", S.with_(
    S.CHUNK_INDEX, KW,
    """
kinds AS (SELECT chunk_id, CASE WHEN contains(text, ' | ') THEN 'table' ELSE lang END AS kind FROM chunks),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY chunk_id) AS r FROM kinds) WHERE r <= 25),
probes AS (SELECT chunk_id AS id, kind, string_agg(term, ' ' ORDER BY kw_rank) AS question
           FROM picked JOIN kw USING (chunk_id) WHERE kw_rank <= 5 GROUP BY 1, 2 HAVING count(*) >= 3),
q AS (SELECT id AS query_id, question FROM probes)""",
    S.hybrid("q", "h", "40"),
    select="""
SELECT kind, count(p.id) AS n_probed, count(*) AS n_total, round(avg(CASE WHEN p.id IS NOT NULL THEN
       CASE WHEN h.rank IS NOT NULL THEN 1.0 ELSE 0.0 END END), 4) AS recall_at_k
FROM picked LEFT JOIN (SELECT id FROM probes) p ON p.id = picked.chunk_id
     LEFT JOIN (SELECT * FROM h WHERE rank <= 10) h ON h.query_id = p.id AND h.chunk_id = p.id
GROUP BY 1"""))
def recall_by_kind(spark, folder):
    ix = index(spark, folder)
    # The plain corpus has text chunks only; here the language and the table mark
    # of a chunk stand for its kind.
    kinds = ix.chunks.select(
        "chunk_id",
        F.when(F.col("text").contains(" | "), "table")
        .otherwise(F.col("section_path")[0]).alias("kind"),
    )
    terms = ix.table("terms").select("chunk_id", "keywords").join(kinds, "chunk_id")
    return X.recall_by_kind(ix, terms)


def hard_ranks(spark, folder):
    def make():
        ix = index(spark, folder)
        probes = spill(P.hard_local_probes(ix), "hard")
        return spill(X.gold_ranks(probes, X.ids_found(ix, probes, 10)), "hard_ranks")

    return once(spark, folder, "hard_ranks", make)


HARD_RUN = [
    S.CHUNK_INDEX, KW, HARD,
    "q AS (SELECT md5(question) AS query_id, any_value(question) AS question FROM hard GROUP BY 1)",
    S.hybrid("q", "h", "40"),
    """
hr AS (SELECT hard.id, hard.doc_id, h.rank FROM hard LEFT JOIN (SELECT * FROM h WHERE rank <= 10) h
       ON h.query_id = md5(hard.question) AND h.chunk_id = hard.chunk_id)""",
]


@query("local_difficulty", S.with_(*HARD_RUN, select="""
SELECT k::INTEGER AS k, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr,
       round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 4) AS recall_at_k,
       round(stddev_samp(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 4) AS sd_at_k
FROM hr, (VALUES (1), (3), (5), (10)) ks(k) GROUP BY 1"""))
def local_difficulty(spark, folder):
    return X.local_difficulty(hard_ranks(spark, folder))


@query("effect_modifiers", S.with_(*HARD_RUN, r"""
feat AS (SELECT c.doc_id, count(*) AS n_chunks, bool_or(contains(text, ' | ')) AS has_tables,
                bool_or(regexp_matches(text, '[A-Za-z0-9)\]]\s*[=<>]\s*[A-Za-z0-9([\-]')) AS has_formulas,
                CASE WHEN any_value(quality) = 1 THEN 'native' ELSE 'scan' END AS source,
                nullif(regexp_extract(c.doc_id, '((?:19|20)\d{2})', 1), '')::INTEGER AS year
         FROM chunks c LEFT JOIN labels l ON c.doc_id = 'd' || l.doc_id GROUP BY c.doc_id),
rows_ AS (SELECT CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END AS rec, feat.* FROM hr JOIN feat USING (doc_id)),
lv AS (SELECT 'pdf_type' AS modifier, source AS level, rec FROM rows_
       UNION ALL SELECT 'has_tables', CASE WHEN has_tables THEN 'True' ELSE 'False' END, rec FROM rows_
       UNION ALL SELECT 'has_formulas', CASE WHEN has_formulas THEN 'True' ELSE 'False' END, rec FROM rows_
       UNION ALL SELECT 'era', CASE WHEN year < 2010 THEN '<2010' ELSE '>=2010' END, rec FROM rows_ WHERE year IS NOT NULL
       UNION ALL SELECT 'doc_size', CASE WHEN n_chunks < 40 THEN 'small(<40c)' ELSE 'large(>=40c)' END, rec FROM rows_)""",
    select="SELECT modifier, level, count(*) AS n, round(avg(rec), 4) AS recall FROM lv GROUP BY 1, 2"))
def effect_modifiers(spark, folder):
    ix = index(spark, folder)
    traits = ix.chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"),
        F.bool_or(F.col("text").contains(" | ")).alias("has_tables"),
        F.bool_or(F.col("text").rlike(r"[A-Za-z0-9)\]]\s*[=<>]\s*[A-Za-z0-9(\[\-]")).alias("has_formulas"),
    )
    features = traits.join(sources(spark, folder), "doc_id", "left").select(
        "doc_id", "n_chunks", "has_tables", "has_formulas",
        F.when(F.col("doc_class") == "native", "native").otherwise("scan").alias("source"),
        F.regexp_extract("doc_id", fixed.YEAR_PATTERN, 1).try_cast("int").alias("year"),
    )
    return X.effect_modifiers(hard_ranks(spark, folder), features)


def global20(spark, folder):
    return once(
        spark, folder, "global20",
        lambda: spill(P.global_probes(index(spark, folder), N_LOCAL, 20), "global20"),
    )


FACTORIAL = [
    S.CHUNK_INDEX, KW, probe_ctes(20),
    "q AS (SELECT DISTINCT id AS query_id, question FROM gold WHERE scope = 'global')",
    "s0 AS (SELECT query_id, 0 AS list_no, question FROM q)",
    list_ctes("s0", "a", 20), S.rrf([shift("alists")], "f_single"),
    sub_ctes("q", "m"), list_ctes("msubs", "m", 20), S.rrf([shift("mlists")], "f_multiquery"),
    follow_ctes("q", "f_single", "w", 20),
    "s1 AS (SELECT query_id, 0 AS list_no, question FROM wfollow)", list_ctes("s1", "b", 20),
    S.rrf([shift("alists"), shift("blists", 5)], "f_agentic"),
    follow_ctes("q", "f_multiquery", "x", 20), sub_ctes("xfollow", "y"), list_ctes("ysubs", "y", 20),
    S.rrf([shift("mlists"), shift("ylists", 5)], "f_both"),
    "cells AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS cell, * FROM f_{c} WHERE rank <= 20" for c in X.CELLS) + ")",
    """
cn AS (SELECT c.cell, g.id, count(*) AS n_gold, count(r.rank) AS hits
       FROM (SELECT DISTINCT cell FROM cells) c, (SELECT * FROM gold WHERE scope = 'global') g
       LEFT JOIN cells r ON r.cell = c.cell AND r.query_id = g.id AND r.chunk_id = g.chunk_id GROUP BY 1, 2),
sz AS (SELECT cell, query_id AS id, count(*) AS returned FROM cells GROUP BY 1, 2)""",
]


@query("factorial", S.with_(*FACTORIAL, select="""
SELECT cell, count(*) AS n, round(avg(hits::DOUBLE / n_gold), 4) AS recall_at_b,
       round(avg(coalesce(returned, 0)), 1) AS avg_returned
FROM cn LEFT JOIN sz USING (cell, id) GROUP BY 1"""))
def factorial(spark, folder):
    return X.factorial(index(spark, folder), global20(spark, folder), N_LOCAL)


GOLD = S.search_tf("tagged", "id", "opening", "otf") + """,
on_ AS (SELECT id, count(*) AS words FROM otf GROUP BY 1 HAVING count(*) >= 3),
gold AS (SELECT t.id, t.scope, t.question, m.chunk_id
         FROM (SELECT o.id, c.chunk_id FROM on_ JOIN otf o USING (id) JOIN ctf c USING (term)
               GROUP BY 1, 2 HAVING count(*) = any_value(words)) m JOIN tagged t USING (id))"""
TAGGED = """
tagged AS (SELECT 'b' || item_id AS id, text AS question, string_split(text, chr(10))[1] AS opening,
                  CASE WHEN contains(text, chr(10)) THEN 'global' ELSE 'local' END AS scope FROM benchmark)"""


@query("gold_rollup", S.with_(
    S.CHUNK_INDEX, TAGGED, GOLD, "q AS (SELECT DISTINCT id AS query_id, question FROM gold)",
    S.hybrid("q", "h", "40"),
    """
sc AS (SELECT g.id, g.scope, count(h.rank)::DOUBLE / count(*) AS recall,
              CASE WHEN count(h.rank) > 0 THEN 1.0 ELSE 0.0 END AS hit
       FROM gold g LEFT JOIN (SELECT * FROM h WHERE rank <= 10) h ON h.query_id = g.id AND h.chunk_id = g.chunk_id
       GROUP BY 1, 2)""",
    select="""
SELECT CASE WHEN grouping(scope) = 1 THEN 'overall' ELSE scope END AS scope, count(*) AS n,
       round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit_rate FROM sc GROUP BY ROLLUP (scope)"""))
def gold_rollup(spark, folder):
    return M.rollup_scopes(external_scores(spark, folder))


def external_scores(spark, folder):
    """Benchmark passages as external questions; gold is the chunks with every word of the first line."""
    ix = index(spark, folder)
    bench = read(spark, folder, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"),
        F.col("text").alias("question"),
        F.split("text", "\n")[0].alias("opening"),
        F.when(F.col("text").contains("\n"), "global").otherwise("local").alias("scope"),
    )
    gold = spill(covering_chunks(ix, bench), "gold")
    asked = spill(bench.join(gold.select("id").distinct(), "id", "left_semi"), "asked")
    scores = M.gold_scores(gold, X.ids_found(ix, asked, 10))
    return asked.select("id", "scope").join(scores, "id")


def covering_chunks(ix, bench):
    """``(id, chunk_id)`` for openings of three or more words.

    A chunk is looked up by an opening's rarest word alone and then holds all others in its own row, so only
    matches are shuffled. A chunk id that stands on several such rows is no match.
    """
    terms = query_terms(bench.select(F.col("id").alias("query_id"), F.col("opening").alias("question")))
    openings = terms.filter(F.col("query_id").isNotNull()).join(ix.table("term_stats"), "term", "left").groupBy("query_id").agg(
        F.collect_set("term").alias("words"),
        F.count("*").alias("n"),
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))["term"].alias("term"),
    )
    asked = spill(openings.filter(F.col("n") >= 3).drop("n"), "openings")
    held = ix.table("terms").select("chunk_id", F.col("terms.term").alias("held"), F.explode("terms.term").alias("term"))
    return (
        held.join(broadcast_within(asked, bounded_count(asked, BROADCAST_ROWS)), "term")
        .filter(F.forall("words", lambda w: F.array_contains("held", w)))
        .groupBy("query_id", "chunk_id")
        .agg(F.count("*").alias("rows"))
        .filter(F.col("rows") == 1)
        .select(F.col("query_id").alias("id"), "chunk_id")
    )
