"""Comparison SQL of the queries that SQL can express."""

from __future__ import annotations

from . import mixing

OP8 = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
                 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS w FROM s),
c AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / w AS stop, sum(source_size) OVER () AS total FROM w),
r AS (SELECT *, (total * 3 / 2 - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(w) OVER after) AS rise FROM c
      WINDOW before AS (ORDER BY stop, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             after AS (ORDER BY stop, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, source_size,
             CASE WHEN free IS NULL OR stop <= free THEN cap::DOUBLE ELSE free * w END AS target
      FROM (SELECT *, max(rise) FILTER (stop > rise) OVER () AS free FROM r)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
u AS (SELECT sized.*, source_size, target, rate, draw,
             floor(rate) + CASE WHEN ('0x' || substr(md5('{mixing.SEED}-' || draw || '-' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT
                                     / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies
      FROM sized JOIN q ON sized.source IS NOT DISTINCT FROM q.source, range({mixing.DRAWS}) g(draw)),
best AS (SELECT source, draw FROM (
           SELECT source, draw, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - any_value(target)), draw) AS k
           FROM u GROUP BY source, draw) WHERE k = 1)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, u.source, copies::BIGINT AS copies
FROM u JOIN best ON u.source IS NOT DISTINCT FROM best.source AND u.draw = best.draw
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
_SHINGLES = f"""CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                     WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END"""

OP1 = f"""
WITH d AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, unnest({_SHINGLES}) AS s FROM i WHERE len(ws) >= 5),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, item_shingles::BIGINT AS item_shingles,
       count(*)::DOUBLE / item_shingles AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles
HAVING count(*)::DOUBLE / item_shingles >= 0.8
UNION ALL
SELECT doc_id, item_id, 1::BIGINT, 1::BIGINT, 1.0::DOUBLE
FROM (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS words FROM documents)
JOIN (SELECT item_id, array_to_string(ws, ' ') AS phrase FROM i WHERE len(ws) BETWEEN 1 AND 4)
  ON contains(words, ' ' || phrase || ' ')
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '')
        AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.fine AND b.fine AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

OP12 = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(
          string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::UBIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]),
          lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT) % 20 AS hit
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM d),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'f' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
-- States of the grammar: B at the start, S after system, U after user, A after assistant. One or two insertions may stand before a row.
ins(q, q2, edits, outs, cost) AS (VALUES
  ('B', 'B', '', []::VARCHAR[], 0), ('S', 'S', '', [], 0), ('U', 'U', '', [], 0), ('A', 'A', '', [], 0),
  ('B', 'U', 'I', ['user:'], 5), ('S', 'U', 'I', ['user:'], 5), ('U', 'A', 'I', ['assistant:'], 5), ('A', 'U', 'I', ['user:'], 5),
  ('B', 'A', 'II', ['user:', 'assistant:'], 10), ('S', 'A', 'II', ['user:', 'assistant:'], 10),
  ('U', 'U', 'II', ['assistant:', 'user:'], 10), ('A', 'A', 'II', ['user:', 'assistant:'], 10)),
s AS (
  SELECT conv_id, 0::BIGINT AS i, 'B' AS q, {'cost': 0, 'audit': '', 'outs': []::VARCHAR[]} AS best FROM (SELECT DISTINCT conv_id FROM c)
  UNION ALL
  SELECT conv_id, i, q, min(best) FROM (
    SELECT s.conv_id, s.i + 1 AS i, m.q, {
        'cost': s.best.cost + ins.cost + m.cost, 'audit': s.best.audit || ins.edits || m.edit, 'outs': s.best.outs || ins.outs || m.outs} AS best
    FROM s JOIN ins ON ins.q = s.q JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1,
      LATERAL (SELECT unnest([
        {'edit': 'D', 'cost': 2, 'q': ins.q2, 'outs': []::VARCHAR[], 'may': true},
        {'edit': 'K', 'cost': CASE fault WHEN 't' THEN 5 ELSE 0 END,
         'q': CASE left(role, 1) WHEN 's' THEN 'S' WHEN 'u' THEN 'U' ELSE 'A' END, 'outs': [role || ':' || text],
         'may': fault IN ('t', 'f') AND (left(role, 1) = 's' AND ins.q2 = 'B' OR left(role, 1) = 'u' AND ins.q2 <> 'U' OR left(role, 1) = 'a' AND ins.q2 = 'U')},
        {'edit': 'R', 'cost': CASE fault WHEN 't' THEN 6 ELSE 1 END, 'q': CASE ins.q2 WHEN 'U' THEN 'A' ELSE 'U' END,
         'outs': [CASE ins.q2 WHEN 'U' THEN 'assistant:' ELSE 'user:' END || text], 'may': fault IN ('t', 'f')}]) AS m) WHERE m.may)
  GROUP BY conv_id, i, q),
e AS (
  SELECT s.conv_id, min({'cost': s.best.cost + ins.cost, 'audit': s.best.audit || ins.edits, 'outs': s.best.outs || ins.outs}) AS best
  FROM s JOIN c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i JOIN ins ON ins.q = s.q WHERE ins.q2 IN ('B', 'A') GROUP BY s.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.outs, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
  LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""

OP13 = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
    (list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]),
         lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END))) AS crc FROM documents),
h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295::UBIGINT) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS given FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM h),
t AS (
  SELECT source, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL
  SELECT source, level + 1, idx, digest, count(*) OVER (PARTITION BY source) FROM (
    SELECT source, level, idx // 16 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM t WHERE n > 1 GROUP BY source, level, idx // 16)),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS idx FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, idx, subroot AS digest, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT level + 1, idx, digest, count(*) OVER () FROM (
    SELECT level, idx // 16 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM u WHERE n > 1 GROUP BY level, idx // 16)),
runs AS (SELECT source, level, idx // 16 AS run, list(digest ORDER BY idx) AS ds, any_value(n) AS n FROM t GROUP BY source, level, idx // 16),
uruns AS (SELECT level, idx // 16 AS run, list(digest ORDER BY idx) AS ds, any_value(n) AS n FROM u GROUP BY level, idx // 16),
p AS (
  SELECT source, idx AS leaf_idx, leaf, 0 AS level, idx, '' AS proof, coalesce(given, leaf) AS folded FROM l
  UNION ALL
  SELECT p.source, leaf_idx, leaf, p.level + 1, idx // 16,
    proof || array_to_string(ds[1:(idx % 16)::INT] || ds[(idx % 16 + 2)::INT:], ''),
    sha256(array_to_string(ds[1:(idx % 16)::INT] || [folded] || ds[(idx % 16 + 2)::INT:], ''))
  FROM p JOIN runs r ON r.source IS NOT DISTINCT FROM p.source AND r.level = p.level AND r.run = p.idx // 16 WHERE r.n > 1),
q AS (
  SELECT top.source, leaf_idx, 0 AS level, s.idx, proof, folded
  FROM (SELECT source, leaf_idx, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM p GROUP BY source, leaf_idx) top
    JOIN s ON s.source IS NOT DISTINCT FROM top.source
  UNION ALL
  SELECT q.source, leaf_idx, q.level + 1, idx // 16,
    proof || array_to_string(ds[1:(idx % 16)::INT] || ds[(idx % 16 + 2)::INT:], ''),
    sha256(array_to_string(ds[1:(idx % 16)::INT] || [folded] || ds[(idx % 16 + 2)::INT:], ''))
  FROM q JOIN uruns r ON r.level = q.level AND r.run = q.idx // 16 WHERE r.n > 1),
e AS (SELECT source, leaf_idx, arg_max(proof, level) AS proof, arg_max(folded, level) AS folded FROM q GROUP BY source, leaf_idx),
r AS (SELECT digest AS root FROM u WHERE n = 1)
SELECT doc_id, l.idx AS index, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN e ON e.source IS NOT DISTINCT FROM l.source AND e.leaf_idx = l.idx CROSS JOIN r
"""

ORACLES = {
    "op1_decontaminate": OP1,
    "op4_embedding_near_dedup": OP4,
    "op6_warc": OP6,
    "op8_mix_sources": OP8,
    "op12_conversation_repair": OP12,
    "op13_merkle_manifest": OP13,
}
