"""Concept, co-occurrence, community and graph-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarrylight.functions import fixed
from quarrylight.operators import concepts as C
from quarrylight.operators import expansion as X
from quarrylight.operators.centroids import centroids
from quarrylight.operators.communities import detect_communities
from quarrylight.operators.leiden import partition_report
from quarrylight.plans.graph import build_graph, graph_hits, graph_search
from quarrylight.recipe import GraphSettings
from quarrylight.session import scratch_path, spill, spread

from . import sqltext as S
from .search import LABEL_CENTROIDS
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


PHRASES = f"""
marked AS (
  SELECT chunk_id, doc_id, array_to_string(list_transform(regexp_extract_all(text, '{C.PHRASE_TOKEN}'),
           lambda t: CASE WHEN lower(t) IN ({S.STOP}) OR NOT regexp_matches(lower(t), '^[a-z]') THEN '|' ELSE lower(t) END), ' ') AS m
  FROM chunks),
runs AS (SELECT chunk_id, doc_id, unnest(list_filter(string_split_regex(m, '{C.PHRASE_BREAK}'), lambda r: r <> '')) AS run FROM marked),
words_ AS (SELECT chunk_id, doc_id, list_transform(string_split(trim(run), ' '),
             lambda w: regexp_replace(w, '{C.PLURAL}', '\\1')) AS ws FROM runs),
inc AS (SELECT DISTINCT array_to_string(ws, ' ') AS concept, chunk_id, doc_id FROM words_
        WHERE len(ws) <= 4 AND length(array_to_string(ws, ' ')) >= 3
          AND NOT (len(ws) = 1 AND ws[1] IN ({S.words(sorted(set(fixed.KEYWORD_STOP) | set(fixed.GENERIC_CONCEPTS)))})))"""

STATS = "stats AS (SELECT concept, count(*) AS freq, count(DISTINCT doc_id) AS doc_count FROM inc GROUP BY 1)"
KEPT = "kept AS (SELECT * FROM stats WHERE freq >= 2 ORDER BY freq DESC, concept LIMIT 4000)"


def edges_cte(cap: int, min_weight: int = 2) -> str:
    """Edges from ``kinc(concept, freq, chunk_id, doc_id)``."""
    return f"""
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY freq, concept) AS rn FROM kinc) WHERE rn <= {cap}),
edges AS (SELECT x.concept AS a, y.concept AS b, count(*) AS weight, count(DISTINCT x.doc_id) AS doc_w
          FROM capped x JOIN capped y ON x.chunk_id = y.chunk_id AND x.concept < y.concept
          GROUP BY 1, 2 HAVING count(*) >= {min_weight})"""


def incidence(spark, folder):
    return once(
        spark, folder, "incidence",
        lambda: spill(C.concept_chunks(index(spark, folder).chunks), "incidence"),
    )


@query("concept_prune", S.with_(S.CHUNKS, PHRASES, STATS, KEPT, select="SELECT * FROM kept"))
def concept_prune(spark, folder):
    return C.surviving(C.concept_stats(incidence(spark, folder)), 2, 4000)


@query("concept_edges", S.with_(
    S.CHUNKS, PHRASES, STATS, KEPT,
    "kinc AS (SELECT inc.*, freq FROM inc JOIN kept USING (concept))", edges_cte(40),
    select="SELECT * FROM edges"))
def concept_edges(spark, folder):
    inc = incidence(spark, folder)
    kept = C.surviving(C.concept_stats(inc), 2, 4000)
    # The survivors are at most 4000 rows by their own limit.
    return C.prune_edges(C.cooccurrence(inc.join(F.broadcast(kept), "concept")))


BASKETS = """
inc AS (SELECT DISTINCT l_partkey::VARCHAR AS concept, 'o' || l_orderkey AS chunk_id, 'c' || o_custkey AS doc_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
kinc AS (SELECT *, count(*) OVER (PARTITION BY concept) AS freq FROM inc)"""


def baskets(spark, folder):
    """Parts as concepts, orders as chunks, customers as documents."""

    def make():
        lines = spread(read(spark, folder, "lineitem").select("l_orderkey", "l_partkey"))
        orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey")
        inc = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_partkey").cast("string").alias("concept"),
            F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("chunk_id"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_id"),
        ).distinct()
        return spill(inc, "baskets")

    return once(spark, folder, "baskets", make)


def basket_frequencies(spark, folder):
    inc = baskets(spark, folder)
    return inc.join(inc.groupBy("concept").agg(F.count("*").alias("freq")), "concept")


def basket_edges(spark, folder):
    return once(
        spark, folder, "basket_edges",
        lambda: spill(C.prune_edges(C.cooccurrence(basket_frequencies(spark, folder))), "edges"),
    )


@query("cooccurrence_edges", S.with_(BASKETS, edges_cte(40), select="SELECT * FROM edges"))
def cooccurrence_edges(spark, folder):
    return C.prune_edges(C.cooccurrence(basket_frequencies(spark, folder)))


@query("cooccurrence_capped", S.with_(BASKETS, edges_cte(3, 1), select="SELECT * FROM edges"))
def cooccurrence_capped(spark, folder):
    return C.cooccurrence(basket_frequencies(spark, folder), per_chunk=3)


TWO_WAY = """
links AS (SELECT a AS u, b AS v, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
heavy AS (SELECT u, max(weight) AS max_weight, count(*) AS degree FROM links GROUP BY 1)"""


@query("hub_prune", S.with_(BASKETS, edges_cte(40), TWO_WAY, select="""
SELECT * FROM edges WHERE a NOT IN (SELECT u FROM heavy WHERE degree > 5)
                      AND b NOT IN (SELECT u FROM heavy WHERE degree > 5)"""))
def hub_prune(spark, folder):
    return C.prune_edges(C.cooccurrence(basket_frequencies(spark, folder)), 2, 5)


@query("max_incident", S.with_(BASKETS, edges_cte(40), TWO_WAY, select="SELECT u, max_weight FROM heavy"))
def max_incident(spark, folder):
    return C.max_incident(basket_edges(spark, folder))


@query("centroids", "WITH " + LABEL_CENTROIDS + """
SELECT label, (i - 1)::INTEGER AS dim, round(m, 6) AS value FROM cent_n""")
def centroids_query(spark, folder):
    cent = centroids(read(spark, folder, "embeddings"), "label", "embedding")
    return cent.select("label", F.posexplode("centroid").alias("dim", "x")).select(
        "label", "dim", F.round(F.col("x").cast("double"), 6).alias("value")
    )


@query("community_sizes", """
SELECT label AS community, count(*) AS size, max(count(*)) OVER () AS largest FROM embeddings GROUP BY 1""")
def community_sizes(spark, folder):
    sizes = spill(
        read(spark, folder, "embeddings").groupBy(F.col("label").alias("community")).agg(F.count("*").alias("size")), "sizes"
    )
    return sizes.select("*", sizes.agg(F.max("size")).scalar().alias("largest"))


SEEDS = LABEL_CENTROIDS + """,
sim AS (SELECT c.label, vec_id::VARCHAR AS concept, sum(c.m * e.x) AS raw FROM cent_n c JOIN comp e USING (i) GROUP BY 1, 2),
lvl AS (SELECT label, greatest(0.3, avg(raw) + 2.0 * stddev_pop(raw)) AS floor FROM sim GROUP BY 1),
seeds AS (SELECT 'l' || label AS query_id, concept, sim FROM (
  SELECT label, concept, round(raw, 6) + 0.0 AS sim,
         row_number() OVER (PARTITION BY label ORDER BY round(raw, 6) DESC, concept) AS rk FROM sim)
  JOIN lvl USING (label) WHERE rk <= 12 AND (rk = 1 OR sim >= floor))"""


def label_world(spark, folder):
    """Concepts, queries and centroids from the embeddings table."""
    emb = read(spark, folder, "embeddings")
    concepts = emb.select(
        F.col("vec_id").cast("string").alias("concept"), F.col("embedding").alias("vector"),
        F.col("label").alias("community"),
    )
    cent = centroids(emb, "label", "embedding").withColumnRenamed("label", "community")
    queries = cent.select(
        F.concat(F.lit("l"), F.col("community").cast("string")).alias("query_id"),
        F.col("centroid").alias("vector"),
    )
    return concepts, queries, cent


@query("seed_select", "WITH " + SEEDS + "\nSELECT * FROM seeds")
def seed_select(spark, folder):
    concepts, queries, _ = label_world(spark, folder)
    return X.select_seeds(concepts, queries)


@query("community_rank", "WITH " + SEEDS + """,
held AS (SELECT query_id, label AS community, sum(sim) AS seed_sum
         FROM seeds JOIN (SELECT vec_id::VARCHAR AS concept, label FROM embeddings) USING (concept) GROUP BY 1, 2),
cc AS (SELECT 'l' || q.label AS query_id, c.label AS community, round(sum(q.m * c.m), 6) AS s
       FROM cent_n q JOIN cent_n c USING (i) GROUP BY 1, 2),
sc AS (SELECT query_id, community, round(coalesce(seed_sum, 0) + 0.5 * s, 6) AS score, seed_sum IS NOT NULL AS seeded
       FROM cc LEFT JOIN held USING (query_id, community)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS rank FROM sc)
SELECT query_id, community, score, rank::INTEGER AS rank FROM rk WHERE rank <= 5 OR seeded""")
def community_rank(spark, folder):
    concepts, queries, cent = label_world(spark, folder)
    seeds = X.select_seeds(concepts, queries)
    ranked = X.rank_communities(seeds, concepts, cent, queries)
    return ranked.filter("relevant").drop("relevant")


BUDGET = GraphSettings(budget_concepts=12, budget_chunks=150)

BRANDS = """
sz AS (SELECT concept, count(*) AS freq FROM inc GROUP BY 1),
member AS (SELECT p_partkey::VARCHAR AS concept, p_brand AS community FROM part),
seeds AS (SELECT community AS query_id, concept, sim FROM (
  SELECT community, concept, round(freq / (SELECT max(freq) FROM sz)::DOUBLE, 6) AS sim,
         row_number() OVER (PARTITION BY community ORDER BY freq DESC, concept) AS rk
  FROM sz JOIN member USING (concept)) WHERE rk <= 3),
rel_c AS (SELECT q.query_id, c.community, row_number() OVER (PARTITION BY q.query_id
            ORDER BY CASE WHEN q.query_id = c.community THEN q.s ELSE 0 END DESC, c.community) AS rk
          FROM (SELECT query_id, sum(sim) AS s FROM seeds GROUP BY 1) q, (SELECT DISTINCT community FROM member) c),
relevant AS (SELECT query_id, community FROM rel_c WHERE rk <= 5)"""


def hop_cte(n: int, before: str, frontier: str) -> str:
    return f"""
reach{n} AS (
  SELECT f.query_id, l.v, f.concept AS u, f.rel, f.rel * (l.weight / h.max_weight::DOUBLE) * 0.5 AS prop
  FROM {frontier} f JOIN links l ON l.u = f.concept JOIN heavy h ON h.u = f.concept
       JOIN member m ON m.concept = l.v JOIN relevant r ON r.query_id = f.query_id AND r.community = m.community
  WHERE NOT EXISTS (SELECT 1 FROM {before} b WHERE b.query_id = f.query_id AND b.concept = l.v)),
first{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY rel DESC, u) AS k FROM reach{n}) WHERE k = 1),
adm{n} AS (SELECT query_id, v AS concept, prop AS rel FROM (
  SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, u, v) AS place FROM first{n} f)
  JOIN (SELECT query_id, count(*) AS used FROM {before} GROUP BY 1) USING (query_id) WHERE place <= {BUDGET.budget_concepts} - used),
vis{n} AS (SELECT query_id, concept, rel, hop FROM {before} UNION ALL SELECT query_id, concept, rel, {n} FROM adm{n})"""


EXPANDED = ",".join([
    BASKETS, edges_cte(40), TWO_WAY, BRANDS,
    "vis0 AS (SELECT query_id, concept, sim AS rel, 0 AS hop FROM seeds)",
    hop_cte(1, "vis0", "vis0"),
    f"""
full1 AS (SELECT query_id FROM vis1 JOIN inc USING (concept) GROUP BY 1 HAVING count(DISTINCT chunk_id) >= {BUDGET.budget_chunks}),
front1 AS (SELECT * FROM vis1 WHERE hop = 1 AND query_id NOT IN (SELECT query_id FROM full1))""",
    hop_cte(2, "vis1", "front1"),
])


def brand_world(spark, folder):
    def make():
        inc = baskets(spark, folder)
        member = read(spark, folder, "part").select(
            F.col("p_partkey").cast("string").alias("concept"), F.col("p_brand").alias("community")
        )
        sizes = spill(inc.groupBy("concept").agg(F.count("*").alias("freq")), "sizes")
        top = sizes.agg(F.max("freq")).scalar()
        order = W.partitionBy("community").orderBy(F.desc("freq"), "concept")
        seeds = spill(
            sizes.join(member, "concept")
            .withColumn("rk", F.row_number().over(order)).filter("rk <= 3")
            .select(F.col("community").alias("query_id"), "concept", F.round(F.col("freq") / top, 6).alias("sim")),
            "seeds",
        )
        relevant = spill(brand_relevance(seeds, member), "relevant")
        return inc, member, seeds, relevant

    return once(spark, folder, "brands", make)


def brand_relevance(seeds, member):
    """Relevant brands by the ranking rule: centroids without direction, so all but the own brand tie at zero."""
    flat = F.array(F.lit(0.0).cast("float"))
    brands = member.select("community").distinct().withColumn("centroid", flat)
    asked = seeds.select("query_id").distinct().withColumn("vector", flat)
    return X.rank_communities(seeds, member, brands, asked).filter("relevant").select("query_id", "community")


def brand_active(spark, folder):
    def make():
        inc, member, seeds, relevant = brand_world(spark, folder)
        return X.expand(seeds, basket_edges(spark, folder), member, relevant, inc, BUDGET)

    return once(spark, folder, "brand_active", make)


@query("bfs_expand", "WITH " + EXPANDED + """
SELECT query_id, concept, round(rel, 6) AS rel, hop FROM vis2""")
def bfs_expand(spark, folder):
    return brand_active(spark, folder).withColumn("rel", F.round("rel", 6))


ACCUM = EXPANDED + """,
acc AS (SELECT query_id, chunk_id, count(*) AS hits, round(sum(rel) * (1 + 0.3 * ln(1 + count(*))), 6) AS score_a
        FROM vis2 JOIN inc USING (concept) GROUP BY 1, 2),
sl AS (SELECT s.query_id, list_no, chunk_id, row_number() OVER (PARTITION BY s.query_id, list_no ORDER BY chunk_id) AS rank
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, concept) AS list_no FROM seeds) s
       JOIN inc USING (concept)),""" + S.rrf(["SELECT query_id, list_no, rank, chunk_id FROM sl"], "sr")


def fused(spark, folder, mode, top):
    inc, _, seeds, _ = brand_world(spark, folder)
    ranked = once(spark, folder, "basket_ranks", lambda: spill(X.rank_incidence(inc), "basket_ranks"))
    found = X.accumulate(brand_active(spark, folder), inc)
    return X.fuse(found, seeds, ranked, top, mode)


@query("graph_gather", "WITH " + ACCUM + "\nSELECT * FROM acc")
def graph_gather(spark, folder):
    return X.accumulate(brand_active(spark, folder), baskets(spark, folder))


@query("graph_fuse_accum", "WITH " + ACCUM + """
SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM (
  SELECT query_id, chunk_id, score_a AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY score_a DESC, chunk_id) AS rank FROM acc) WHERE rank <= 20""")
def graph_fuse_accum(spark, folder):
    return fused(spark, folder, "accum", 20)


@query("graph_fuse_rrf", "WITH " + ACCUM + """
SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM (
  SELECT query_id, chunk_id, score_a AS score, row_number() OVER (PARTITION BY query_id
           ORDER BY coalesce((SELECT count(*) FROM sr z WHERE z.query_id = acc.query_id) - sr.rank + 1, 0) DESC,
                    score_a DESC, chunk_id) AS rank
  FROM acc LEFT JOIN sr USING (query_id, chunk_id)) WHERE rank <= 20""")
def graph_fuse_rrf(spark, folder):
    return fused(spark, folder, "rrf", 20)


@query("graph_fuse_hybrid", "WITH " + ACCUM + """,
pts AS (SELECT query_id, chunk_id, score_a,
               coalesce(max(sr.rank) OVER (PARTITION BY query_id) - sr.rank + 1, 0)::DOUBLE AS p
        FROM acc LEFT JOIN sr USING (query_id, chunk_id)),
ends AS (SELECT *, min(score_a) OVER w AS a0, max(score_a) OVER w AS a1, min(p) OVER w AS p0, max(p) OVER w AS p1
         FROM pts WINDOW w AS (PARTITION BY query_id)),
bl AS (SELECT query_id, chunk_id, round(0.5 * CASE WHEN a1 = a0 THEN 0 ELSE (score_a - a0) / (a1 - a0) END
              + 0.5 * CASE WHEN p1 = p0 THEN 0 ELSE (p - p0) / (p1 - p0) END, 6) AS score FROM ends)
SELECT query_id, rank::INTEGER AS rank, chunk_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bl) WHERE rank <= 20""")
def graph_fuse_hybrid(spark, folder):
    return fused(spark, folder, "hybrid", 20)


@query("communities")
def communities(spark, folder):
    return detect_communities(basket_edges(spark, folder))


# Brands as a partition that SQL knows too: its parts, its quality and the nodes that would gain by one move.
BRAND_PARTITION = """
lab AS (SELECT DISTINCT u AS node, p_brand AS c FROM links JOIN part ON p_partkey::VARCHAR = u),
deg AS (SELECT u AS node, sum(weight)::DOUBLE AS k FROM links GROUP BY 1),
tot AS (SELECT sum(weight)::DOUBLE AS w FROM links),
vol AS (SELECT c, sum(k) AS volume, count(*) AS members FROM lab JOIN deg USING (node) GROUP BY 1),
tow AS (SELECT u, b.c AS dest, sum(weight)::DOUBLE AS shared FROM links JOIN lab b ON b.node = v WHERE u <> v GROUP BY 1, 2),
stay AS (SELECT lab.node, lab.c, k, members, coalesce(shared, 0) - k / w * (volume - k) AS s
         FROM lab JOIN deg USING (node) JOIN vol USING (c) LEFT JOIN tow ON tow.u = lab.node AND tow.dest = lab.c, tot),
go AS (SELECT node, max(round(shared - k / w * volume, 9)) AS g
       FROM stay JOIN tow ON tow.u = stay.node AND tow.dest <> stay.c JOIN vol ON vol.c = tow.dest, tot
       WHERE stay.members > 1 OR vol.members > 1 OR tow.dest < stay.c GROUP BY 1),
gain AS (SELECT c, count(*) AS gaining FROM stay LEFT JOIN go USING (node)
         WHERE greatest(coalesce(g, -1e300), CASE WHEN members > 1 THEN 0 ELSE -1e300 END) - s > 1e-9 GROUP BY 1),
own AS (SELECT a.c, sum(weight) / 2 AS inside FROM links JOIN lab a ON a.node = u JOIN lab b ON b.node = v AND b.c = a.c GROUP BY 1),
near AS (SELECT u, v, a.c FROM links JOIN lab a ON a.node = u JOIN lab b ON b.node = v AND b.c = a.c),
reach AS (SELECT node AS root, node, c FROM lab UNION SELECT root, v, reach.c FROM reach JOIN near ON near.u = reach.node),
cut AS (SELECT c, count(DISTINCT low) AS parts FROM (SELECT node, c, min(root) AS low FROM reach GROUP BY 1, 2) GROUP BY 1)"""


def brand_labels(spark, folder):
    edges = basket_edges(spark, folder)
    nodes = edges.select(F.col("a").alias("concept")).union(edges.select("b")).distinct()
    brands = read(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("concept"), F.col("p_brand").alias("community")
    )
    return brands.join(nodes, "concept")


@query("partition_quality", S.with_(BASKETS, edges_cte(40), TWO_WAY, BRAND_PARTITION, select="""
SELECT c AS community, members, round(coalesce(inside, 0)::DOUBLE, 6) AS inside, round(volume, 6) AS volume,
       round(2 * coalesce(inside, 0) / w - (volume / w) ** 2, 9) AS quality, parts, coalesce(gaining, 0) AS gaining
FROM vol LEFT JOIN own USING (c) JOIN cut USING (c) LEFT JOIN gain USING (c), tot""").replace("WITH", "WITH RECURSIVE", 1))
def partition_quality(spark, folder):
    found = partition_report(basket_edges(spark, folder), brand_labels(spark, folder))
    return found.select(
        "community", "members", F.round("inside", 6).alias("inside"), F.round("volume", 6).alias("volume"),
        F.round("quality", 9).alias("quality"), "parts", "gaining",
    )


def graph(spark, folder):
    return once(
        spark, folder, "graph",
        lambda: build_graph(index(spark, folder).chunks, scratch_path(spark, "graph")),
    )


@query("graph_meta")
def graph_meta(spark, folder):
    return graph(spark, folder).table("meta").drop("params")


@query("graph_search")
def graph_search_query(spark, folder):
    ix, batch = index(spark, folder), benchmark_batch(spark, folder)
    return graph_search(graph(spark, folder), batch, top_k=8, index=ix, chunks=ix.chunks).ranked


@query("graph_hits")
def graph_hits_query(spark, folder):
    found = graph_hits(graph(spark, folder), benchmark_batch(spark, folder), index(spark, folder), top_k=8)
    return found.select("query_id", "rank", "score", "chunk.*", F.col("graph.n_candidates").alias("n_candidates"))


@query("four_arms")
def four_arms(spark, folder):
    """Mean recall of hybrid, multi-query, graph and fused retrieval on global probes."""
    from quarrylight.evaluation.experiments import arm_means
    from quarrylight.plans.arms import four_arm_results

    from .evaluate import N_LOCAL, global20

    probes = global20(spark, folder)
    arms = four_arm_results(index(spark, folder), graph(spark, folder), probes, N_LOCAL, 20)
    return arm_means(probes, arms)
