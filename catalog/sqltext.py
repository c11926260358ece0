"""Building blocks of the comparison SQL."""

from __future__ import annotations

from quarrylight.functions import fixed


def words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = words(fixed.KEYWORD_STOP)
WORD = fixed.WORD_PATTERN
SEARCH = fixed.SEARCH_PATTERN

CHUNKS = """
lines AS (
  SELECT doc_id, lang, source,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls
  FROM documents),
chunks AS (
  SELECT 'd' || doc_id AS doc_id, 'd' || doc_id || '-c' || pos AS chunk_id, text, lang, source
  FROM (SELECT doc_id, lang, source, unnest(ls) AS text, generate_subscripts(ls, 1) AS pos FROM lines))"""


def tf(source: str, key: str, text: str, out: str, stop: str = STOP) -> str:
    """Term counts with first position: ``out(key, term, n, fp)``."""
    return f"""
{out} AS (
  SELECT {key}, term, count(*) AS n, min(p) AS fp
  FROM (SELECT {key}, lower(w) AS term, p
        FROM (SELECT {key}, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
              FROM (SELECT {key}, regexp_extract_all({text}, '{WORD}') AS ws FROM {source})))
  WHERE term NOT IN ({stop})
  GROUP BY {key}, term)"""


def search_tf(source: str, key: str, text: str, out: str) -> str:
    """Counts of search words: ``out(key, term, n)``."""
    return f"""
{out} AS (
  SELECT {key}, term, count(*) AS n
  FROM (SELECT {key}, lower(unnest(regexp_extract_all({text}, '{SEARCH}'))) AS term FROM {source})
  GROUP BY {key}, term)"""


def keywords(tf_name: str, key: str, out: str) -> str:
    """All terms with their keyword rank: ``out(key, term, n, kw_rank)``."""
    return f"""
{out} AS (
  SELECT {key}, term, n, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, fp) AS kw_rank
  FROM {tf_name})"""


def vectors(tf_name: str, key: str, out: str) -> str:
    """Hashed unit vectors in sparse form: ``out(key, b, w)``."""
    return f"""
{out}_raw AS (
  SELECT {key}, ('0x' || substr(md5(term), 1, 8))::BIGINT % 384 AS b,
         sum((CASE WHEN ('0x' || substr(md5(term), 9, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE
             * (1 + ln(n))) AS x
  FROM {tf_name} GROUP BY 1, 2),
{out} AS (
  SELECT {key}, b, (x / CASE WHEN size = 0 THEN 1 ELSE size END)::FLOAT::DOUBLE AS w
  FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {key})) AS size FROM {out}_raw))"""


CHUNK_INDEX = (
    CHUNKS
    + ","
    + search_tf("chunks", "chunk_id", "text", "ctf")
    + ","
    + vectors("ctf", "chunk_id", "cvec")
    + """,
dl AS (SELECT chunk_id, sum(n) AS dl FROM ctf GROUP BY 1),
corpus AS (SELECT count(*)::DOUBLE AS n_chunks,
                  (SELECT sum(n) FROM ctf)::DOUBLE / count(*) AS avg_len FROM chunks),
df AS (SELECT term, count(*) AS df FROM ctf GROUP BY 1)"""
)


def dense(q: str, out: str, k: str, fill: bool = True) -> str:
    """Dense arm: ``out(query_id, chunk_id, score, rank)``; ``k`` is a number or a q column."""
    base = (
        f"SELECT q.query_id, c.chunk_id, 0.0::DOUBLE AS s FROM {q} q, chunks c UNION ALL "
        if fill
        else ""
    )
    return f"""
{out}_s AS (
  SELECT query_id, chunk_id, round(sum(s), 6) + 0.0 AS score FROM (
    {base}
    SELECT v.query_id, c.chunk_id, v.w * c.w AS s FROM {out}_v v JOIN cvec c USING (b))
  GROUP BY 1, 2),
{out} AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM {out}_s) JOIN {q} USING (query_id) WHERE rank <= {k})"""


def sparse(q: str, out: str, k: str) -> str:
    """BM25 arm: ``out(query_id, chunk_id, score, rank)``."""
    return f"""
{out}_s AS (
  SELECT t.query_id, c.chunk_id,
         round(sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5))
             * (c.n * 2.2 / (c.n + 1.2 * (1 - 0.75 + 0.75 * dl / avg_len)))), 6) AS score
  FROM {out}_t t JOIN ctf c USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), corpus
  GROUP BY 1, 2),
{out} AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM {out}_s) JOIN {q} USING (query_id) WHERE rank <= {k})"""


def rrf(arms: list[str], out: str, keys: str = "query_id", rrf_k: int = 60) -> str:
    """Fuse select texts giving ``(keys, list_no, rank, chunk_id)`` into ``out``."""
    union = " UNION ALL ".join(arms)
    return f"""
{out}_g AS (
  SELECT {keys}, chunk_id,
         list_reduce(list_prepend(0.0::DOUBLE, list(1.0::DOUBLE / ({rrf_k} + rank) ORDER BY list_no, rank)),
                     lambda a, b: a + b) AS score,
         min((list_no, rank)) AS first_place
  FROM ({union}) GROUP BY {keys}, chunk_id),
{out} AS (
  SELECT {keys}, chunk_id, score,
         row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, first_place, chunk_id) AS rank
  FROM {out}_g)"""


def hybrid(q: str, out: str, candidate_k: str, fill: bool = True) -> str:
    """Hybrid search of the queries in ``q(query_id, question)``: ``out(query_id, chunk_id, score, rank)``."""
    return ",".join(
        [
            search_tf(q, "query_id", "question", f"{out}_qtf"),
            vectors(f"{out}_qtf", "query_id", f"{out}_d_v"),
            f"\n{out}_b_t AS (SELECT query_id, term FROM {out}_qtf)",
            dense(q, f"{out}_d", candidate_k, fill),
            sparse(q, f"{out}_b", candidate_k),
            rrf(
                [
                    f"SELECT query_id, 0 AS list_no, rank, chunk_id FROM {out}_d",
                    f"SELECT query_id, 1 AS list_no, rank, chunk_id FROM {out}_b",
                ],
                out,
            ),
        ]
    )


BENCH_Q = "q AS (SELECT 'b' || item_id AS query_id, text AS question FROM benchmark)"


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select
