"""Page parsing, sections, chunking, classification and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import fixed, text as tx
from quarrylight.operators import artifacts as A
from quarrylight.operators import captions as CA
from quarrylight.operators import classify as CL
from quarrylight.operators import sections as SE
from quarrylight.operators.chunking import document_chunks, document_meta
from quarrylight.plans.ingest import intermediate_documents
from quarrylight.session import spill, spread
from quarrylight.sources import pages as PG

from . import sqltext as S
from .workspace import once, read

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _decoded(expr: str) -> str:
    for code, char in PG.ENTITIES.items():
        expr = f"replace({expr}, '{code}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


# RE2 has no back references, so each skipped element is removed on its own; those of
# these pages do not nest.
_BODY = "translate(html, chr(1) || chr(2), '  ')"
for _pattern in (r"(?s)<!--.*?-->", *[rf"(?si)<{t}\b.*?</{t}\s*>" for t in ("head", "script", "style", "template", "noscript")]):
    _BODY = f"regexp_replace({_BODY}, '{_pattern}', ' ', 'g')"
_BODY = f"regexp_replace({_BODY}, '{PG.BLOCK_BREAK}', chr(1) || chr(2), 'g')"

BLOCKS = f"""
pieces AS (SELECT 'p' || page_id AS doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS block_no
           FROM (SELECT page_id, string_split(chr(2) || regexp_replace({_BODY}, '{PG.BLOCK_OPEN}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM pages)),
cut AS (SELECT doc_id, block_no, lower(string_split(piece, chr(2))[1]) AS tag, substr(piece, instr(piece, chr(2)) + 1) AS content FROM pieces),
blocks AS (
  SELECT doc_id, block_no, tag,
         CASE tag {' '.join(f"WHEN '{t}' THEN {s}" for t, s in PG.TAG_SIZES.items())} ELSE {PG.TEXT_SIZE} END::DOUBLE AS size,
         starts_with(ltrim(content), '<b>') AS bold,
         trim(regexp_replace({_decoded("regexp_replace(content, '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g')) AS text
  FROM cut WHERE text <> '')"""

MARKED = """
bs AS (SELECT doc_id, size AS body_size FROM (
  SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(block_no)) AS k
  FROM blocks GROUP BY 1, 2) WHERE k = 1),
lv AS (SELECT doc_id, size, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC), 3) AS size_level
       FROM (SELECT DISTINCT doc_id, size FROM blocks) JOIN bs USING (doc_id) WHERE size > body_size + 0.5),
marked AS (SELECT b.*, CASE WHEN size_level IS NOT NULL AND length(text) <= 120 THEN size_level
             WHEN bold AND length(text) <= 80 AND NOT ends_with(rtrim(text), '.') AND b.size >= body_size THEN 3 ELSE 0 END AS heading
           FROM blocks b JOIN bs USING (doc_id) LEFT JOIN lv ON lv.doc_id = b.doc_id AND lv.size = b.size)"""

SECTIONS = """
placed AS (SELECT *, sum(CASE WHEN heading > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS section_no FROM marked),
heads AS (SELECT doc_id, section_no, heading, text FROM placed WHERE heading > 0),
path AS (SELECT h.doc_id, h.section_no, string_agg(o.text, ' > ' ORDER BY o.section_no) AS path FROM heads h JOIN heads o
         ON o.doc_id = h.doc_id AND o.section_no <= h.section_no AND (o.section_no = h.section_no OR o.heading < h.heading)
         WHERE NOT EXISTS (SELECT 1 FROM heads z WHERE z.doc_id = h.doc_id AND z.section_no > o.section_no
                           AND z.section_no <= h.section_no AND z.heading <= o.heading)
         GROUP BY 1, 2),
sect AS (SELECT * FROM (
  SELECT p.doc_id, p.section_no, max(heading) AS level, coalesce(max(text) FILTER (heading > 0), '') AS title,
         coalesce(any_value(path.path), '') AS path,
         coalesce(trim(string_agg(text, chr(10) || chr(10) ORDER BY block_no) FILTER (heading = 0)), '') AS body
  FROM placed p LEFT JOIN path ON path.doc_id = p.doc_id AND path.section_no = p.section_no GROUP BY 1, 2)
  WHERE title <> '' OR body <> '')"""


def page_blocks(spark, folder):
    return once(
        spark, folder, "blocks",
        lambda: spill(
            PG.html_blocks(
                spread(read(spark, folder, "pages").select("page_id", "html")),
                F.concat(F.lit("p"), F.col("page_id").cast("string")),
            ),
            "blocks",
        ),
    )


@query("page_blocks", "WITH " + BLOCKS + """
SELECT doc_id, block_no::INTEGER AS block_no, size, bold, text FROM blocks""")
def page_blocks_query(spark, folder):
    return PG.html_blocks(
        spread(read(spark, folder, "pages").select("page_id", "html")),
        F.concat(F.lit("p"), F.col("page_id").cast("string")),
    ).select("doc_id", "block_no", "size", "bold", "text")


@query("block_headings", "WITH " + BLOCKS + "," + MARKED + """
SELECT doc_id, block_no::INTEGER AS block_no, heading::INTEGER AS heading FROM marked""")
def block_headings(spark, folder):
    return SE.mark_headings(page_blocks(spark, folder)).select("doc_id", "block_no", "heading")


@query("sections", "WITH " + BLOCKS + "," + MARKED + "," + SECTIONS + """
SELECT doc_id, section_no::INTEGER AS section_no, level::INTEGER AS level, title, path, body FROM sect""")
def sections(spark, folder):
    found = SE.sections(SE.mark_headings(page_blocks(spark, folder)))
    return found.select(
        "doc_id", "section_no", "level", "title", F.array_join("section_path", " > ").alias("path"), "body"
    )


def word_heads(spark, folder):
    """Document lines as typed blocks: a line's word count modulo five names its level."""
    lines = spread(read(spark, folder, "documents")).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.posexplode(F.split("text", "\n")).alias("pos", "text"),
    )
    n = F.size(F.split("text", " "))
    return lines.select(
        "doc_id", (F.col("pos") + 1).alias("block_no"), F.lit(1).alias("page"), "text",
        F.when(n % 5 < 3, F.lit("section_header")).otherwise(F.lit("text")).alias("label"),
        (n % 5 + 1).alias("level"),
    )


@query("section_paths", r"""
WITH l AS (SELECT doc_id, trim(regexp_replace(text, '^[\s\x0B\x85\x{A0}\x{2028}\x{2029}]+|[\s\x0B\x85\x{A0}\x{2028}\x{2029}]+$', '', 'g')) AS text, block_no, len(string_split(text, ' ')) % 5 AS m
  FROM (SELECT 'd' || doc_id AS doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) AS block_no
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
marked AS (SELECT doc_id, block_no, text, CASE WHEN m < 3 THEN m + 1 ELSE 0 END AS heading FROM l WHERE text <> ''),
placed AS (SELECT *, sum(CASE WHEN heading > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS section_no FROM marked),
h AS (SELECT doc_id, section_no, heading, text,
        max(CASE WHEN heading <= 1 THEN section_no END) OVER w AS s1, max(CASE WHEN heading <= 2 THEN section_no END) OVER w AS s2
      FROM placed WHERE heading > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY section_no))
SELECT h.doc_id, h.section_no::INTEGER AS section_no, h.heading::INTEGER AS level,
       concat_ws(' > ', CASE WHEN h.heading > 1 AND a.heading = 1 THEN a.text END,
                        CASE WHEN h.heading > 2 AND b.heading = 2 THEN b.text END, h.text) AS path
FROM h LEFT JOIN h a ON a.doc_id = h.doc_id AND a.section_no = h.s1
       LEFT JOIN h b ON b.doc_id = h.doc_id AND b.section_no = h.s2""")
def section_paths(spark, folder):
    found = SE.sections(SE.mark_typed_headings(word_heads(spark, folder)), max_level=5)
    return found.filter("level > 0").select(
        "doc_id", "section_no", "level", F.array_join("section_path", " > ").alias("path")
    )


MARKDOWN = """
md AS (SELECT doc_id, trim(string_agg(concat_ws(chr(10) || chr(10),
         CASE WHEN title <> '' THEN repeat('#', greatest(1, least(6, level::INTEGER))) || ' ' || title END, nullif(body, '')),
         chr(10) || chr(10) ORDER BY section_no)) || chr(10) AS markdown FROM sect GROUP BY 1)"""


def page_documents(spark, folder):
    return once(
        spark, folder, "page_documents",
        lambda: spill(intermediate_documents(page_blocks(spark, folder)), "documents"),
    )


@query("page_markdown", "WITH " + BLOCKS + "," + MARKED + "," + SECTIONS + "," + MARKDOWN + """
SELECT doc_id, markdown, substr(sha256(markdown), 1, 16) AS sha256_16 FROM md""")
def page_markdown(spark, folder):
    md = SE.markdown(SE.sections(SE.mark_headings(page_blocks(spark, folder))))
    return md.withColumn("sha256_16", tx.digest16(F.col("markdown")))


CHUNKED = """
pc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS n,
              CASE WHEN title <> '' THEN trim(title || chr(10) || chr(10) || body) ELSE body END AS text, path, title
       FROM sect WHERE body <> ''),
pcall AS (SELECT doc_id, n, text, CASE WHEN path <> '' THEN path ELSE title END AS path FROM pc
          UNION ALL SELECT doc_id, 1, trim(markdown, chr(10) || ' '), '' FROM md
          WHERE doc_id NOT IN (SELECT doc_id FROM pc) AND trim(markdown, chr(10) || ' ') <> '')"""


@query("page_chunks", "WITH " + BLOCKS + "," + MARKED + "," + SECTIONS + "," + MARKDOWN + "," + CHUNKED + """
SELECT doc_id || '-c' || n AS chunk_id, doc_id, 'text' AS kind, path, 1 AS page, text FROM pcall""")
def page_chunks(spark, folder):
    return document_chunks(page_documents(spark, folder)).select(
        "chunk_id", "doc_id", "kind", F.array_join("section_path", " > ").alias("path"), "page", "text"
    )


@query("document_meta", "WITH " + BLOCKS + "," + MARKED + "," + SECTIONS + "," + MARKDOWN + "," + CHUNKED + """
SELECT doc_id AS id, 'pdf-native' AS source, 'pdf-native' AS route, substr(sha256(markdown), 1, 16) AS sha256_16,
       (SELECT count(*) FROM pcall WHERE pcall.doc_id = md.doc_id)::INTEGER AS n_chunks, 0 AS n_tables,
       CASE WHEN (SELECT count(*) FROM pcall WHERE pcall.doc_id = md.doc_id) = 0 THEN 'needs_human_review' ELSE 'ok' END AS status FROM md""")
def document_meta_query(spark, folder):
    return document_meta(page_documents(spark, folder)).select(
        "id", "source", "route", "sha256_16", "n_chunks", "n_tables", "status"
    )


@query("noise_ratio", r"""
SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE bad / n::DOUBLE END, 6) AS noise FROM (
  SELECT doc_id, length(s) AS n,
         length(s) - length(regexp_replace(s, '[\x00-\x1F\x7F-\x9F\x{FFFD}\x{E000}-\x{F8FF}\x{FB00}-\x{FB04}]', '', 'g')) AS bad
  FROM (SELECT doc_id, regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]', '', 'g') AS s FROM documents))""")
def noise_query(spark, folder):
    return spread(read(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", F.round(tx.noise_ratio(F.col("text")), 6).alias("noise")
    )


@query("formula_lines", rf"""
WITH l AS (SELECT 'd' || doc_id AS doc_id, line_no, trim(line) AS s FROM (
             SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no
             FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
           UNION ALL SELECT 'o' || l_orderkey, l_linenumber,
             CASE l_returnflag WHEN 'A' THEN 'x' || l_partkey || ' = y + z  (' || l_linenumber || ')'
                  WHEN 'R' THEN 'p=' || l_partkey || '*' || l_suppkey || '^2 - √3' ELSE 'order ' || l_partkey || ' (' || l_linenumber || ')' END
           FROM lineitem),
d AS (SELECT *, length(ns) AS n, length(ns) - length(regexp_replace(ns, '[{fixed.MATH_CLASS}]', '', 'g')) AS m
      FROM (SELECT *, regexp_replace(s, '[\s\x0B\x1C-\x1F\x85\p{{Z}}]', '', 'g') AS ns FROM l)),
f AS (SELECT *, regexp_matches(s, '{fixed.EQUATION_NUMBER_PATTERN}') AS num, regexp_matches(s, '{fixed.RELATION_PATTERN}') AS rel,
             m / greatest(n, 1)::DOUBLE >= 0.18 AS dense FROM d)
SELECT doc_id, line_no::INTEGER AS line_no, s AS text, num AS numbered, rel AS related, dense,
       length(s) >= 3 AND ((num AND (rel OR dense)) OR (dense AND rel)) AS formula FROM f WHERE num OR rel OR dense""")
def formula_lines(spark, folder):
    lines = spread(read(spark, folder, "documents")).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.posexplode(F.split("text", "\n")).alias("pos", "text"),
    ).select("doc_id", (F.col("pos") + 1).alias("line_no"), F.trim("text").alias("text"))
    part, supp, no = (F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    orders = read(spark, folder, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("doc_id"),
        F.col("l_linenumber").alias("line_no"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("x"), part, F.lit(" = y + z  ("), no, F.lit(")")))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("p="), part, F.lit("*"), supp, F.lit("^2 - √3")))
        .otherwise(F.concat(F.lit("order "), part, F.lit(" ("), no, F.lit(")"))).alias("text"),
    )
    both = lines.unionByName(orders)
    return both.select("doc_id", "line_no", "text", tx.formula_signs(F.col("text")).alias("s"),
                       tx.is_formula(F.col("text")).alias("formula")).select(
        "doc_id", "line_no", "text", "s.*", "formula"
    ).filter("numbered OR related OR dense")


# Order lines stand for pages: discount for raster coverage, quantity for text
# length, tax for noise, line number for the font count.
TRAITS = """
tr AS (SELECT 'o' || l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity))::INTEGER AS page, count(*) OVER (PARTITION BY l_orderkey) AS n_pages,
              round(l_discount * 10, 4) AS coverage, (l_quantity * 8)::INTEGER AS n_chars, l_tax * 0.73131 AS noise,
              (l_linenumber % 3)::INTEGER AS n_fonts, CASE WHEN l_returnflag = 'A' THEN 2 ELSE 1 END AS col_guess FROM lineitem),
lab AS (SELECT *, CASE WHEN NOT (coverage >= 0.80 OR (coverage >= 0.55 AND n_fonts <= 1)) THEN 'native'
                       WHEN n_chars >= 200 AND noise < 0.06 THEN 'scan-ocr' ELSE 'scan-image' END AS label FROM tr)"""


def line_traits(spark, folder):
    from pyspark.sql.window import Window as W

    lines = spread(
        read(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_tax", "l_returnflag",
            "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        )
    )
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    return lines.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("doc_id"),
        F.row_number().over(order).alias("page"),
        F.count("*").over(W.partitionBy("l_orderkey")).cast("int").alias("n_pages"),
        F.round(F.col("l_discount") * 10, 4).alias("coverage"),
        (F.col("l_quantity") * 8).cast("int").alias("n_chars"),
        (F.col("l_tax") * 0.73131).alias("noise"),
        (F.col("l_linenumber") % 3).cast("int").alias("n_fonts"),
        F.when(F.col("l_returnflag") == "A", 2).otherwise(1).alias("col_guess"),
    )


@query("page_labels", "WITH " + TRAITS + "\nSELECT doc_id, page, label FROM lab")
def page_labels(spark, folder):
    return line_traits(spark, folder).select(
        "doc_id", "page",
        CL.page_label(F.col("coverage"), F.col("n_chars"), F.col("noise"), F.col("n_fonts")).alias("label"),
    )


@query("source_class", "WITH " + TRAITS + """,
v AS (SELECT *, NOT (page = min(page) OVER (PARTITION BY doc_id) AND n_pages >= 3) AS votes FROM lab),
a AS (SELECT doc_id, any_value(n_pages) AS n_pages, round(avg(coverage), 4) AS image_coverage, bool_or(n_chars >= 40) AS has_text_layer,
             count(*) FILTER (votes) AS nv, count(*) FILTER (votes AND label = 'scan-ocr') AS no, count(*) FILTER (votes AND label = 'scan-image') AS ni,
             count(*) FILTER (col_guess = 2) AS two, count(*) FILTER (col_guess = 1) AS one, round(avg(noise), 4) AS mean_noise_ratio,
             string_agg(label, ',' ORDER BY page) AS page_labels FROM v GROUP BY 1),
s AS (SELECT *, (no + ni) / nv::DOUBLE AS fr, contains(o.clerk, 'kofax') AS sig FROM a
      JOIN (SELECT 'o' || o_orderkey AS doc_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'kofax' ELSE lower(o_orderpriority) END AS clerk FROM orders) o USING (doc_id))
SELECT doc_id, n_pages::INTEGER AS n_pages, image_coverage, has_text_layer, CASE WHEN two > one THEN 2 ELSE 1 END AS col_count_guess,
       fr >= 0.5 AS looks_scanned, CASE WHEN fr < 0.5 THEN 'pdf-native' WHEN no >= ni THEN 'pdf-scan-ocr' ELSE 'pdf-scan-image' END AS source_class,
       round(least(1.0, 0.55 + 0.25 * greatest(0.0, ((CASE WHEN fr >= 0.5 THEN fr ELSE 1 - fr END) - 0.5) / 0.5)
             + CASE WHEN (fr >= 0.5) = sig THEN 0.2 ELSE 0 END), 4) AS source_confidence,
       CASE WHEN fr >= 0.5 THEN 'pdf-scan' ELSE 'pdf-native' END AS route, round(fr, 4) AS scan_fraction, mean_noise_ratio, page_labels
FROM s
UNION ALL
SELECT 'o' || o_orderkey, 0, 0.0, false, 1, false, 'pdf-native', 0.0, 'pdf-native', 0.0, 0.0, ''
FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT doc_id FROM a)""")
def source_class(spark, folder):
    info = read(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("doc_id"),
        F.when(F.col("o_orderpriority").startswith("1"), "Kofax").otherwise(F.col("o_orderpriority")).alias("producer"),
        F.lit("").alias("creator"),
    )
    found = CL.classify_documents(line_traits(spark, folder), info)
    return found.select(
        "doc_id", "n_pages", "image_coverage", "has_text_layer", "col_count_guess", "looks_scanned",
        "source_class", "source_confidence", "route", "signals.scan_fraction", "signals.mean_noise_ratio",
        F.array_join("signals.page_labels", ",").alias("page_labels"),
    )


@query("page_sample", """
WITH n AS (SELECT 'c' || o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY 1)
SELECT DISTINCT doc_id, (CASE WHEN n <= 8 THEN i ELSE floor(j * (n / 8.0::DOUBLE)) END)::INTEGER AS page
FROM n, (SELECT unnest(range(8)) AS j), (SELECT 0 AS z), LATERAL (SELECT j AS i) WHERE n > 8 OR i < n""")
def page_sample(spark, folder):
    counts = read(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"))
    return counts.select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_id"),
        F.explode(CL.sampled_pages(F.col("n"))).alias("page"),
    )


# Order lines stand for layout boxes: odd lines are images, even lines are text.
GEOMETRY = """
box AS (SELECT 'o' || l_orderkey AS doc_id, (l_suppkey % 2)::INTEGER AS page, l_linenumber AS no,
               l_quantity * 4 AS x0, l_quantity * 4 + 120 AS x1, (l_partkey % 40)::DOUBLE * 10 AS y0, (l_partkey % 40)::DOUBLE * 10 + 30 AS y1,
               CASE WHEN l_returnflag = 'N' THEN '{word} ' ELSE 'see ' END || l_linenumber || ' of  ' || l_orderkey AS text FROM lineitem),
j AS (SELECT o.doc_id, o.page, o.no AS object_no, regexp_replace(b.text, '\\s+', ' ', 'g') AS caption, b.no AS block_no,
             b.y0 - o.y1 AS below, o.y0 - b.y1 AS above
      FROM box o JOIN box b ON o.doc_id = b.doc_id AND o.page = b.page AND o.no % 2 = 1 AND b.no % 2 = 0
      WHERE least(b.x1, o.x1) - greatest(b.x0, o.x0) > 0 AND starts_with(b.text, '{word} ')),
k AS (SELECT *, {distance} AS d FROM j WHERE below BETWEEN 0 AND {window} OR above BETWEEN 0 AND {window})
SELECT doc_id, page, object_no, min_by(caption, (d, block_no)) AS caption FROM k GROUP BY 1, 2, 3"""


def boxes(spark, folder, word):
    lines = spread(read(spark, folder, "lineitem"))
    y = (F.col("l_partkey") % 40).cast("double") * 10
    box = lines.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("doc_id"),
        (F.col("l_suppkey") % 2).cast("int").alias("page"),
        F.col("l_linenumber").alias("no"),
        (F.col("l_quantity") * 4).alias("x0"), (F.col("l_quantity") * 4 + 120).alias("x1"),
        y.alias("y0"), (y + 30).alias("y1"),
        F.concat(
            F.when(F.col("l_returnflag") == "N", F.lit(word + " ")).otherwise(F.lit("see ")),
            F.col("l_linenumber").cast("string"), F.lit(" of  "), F.col("l_orderkey").cast("string"),
        ).alias("text"),
    )
    objects = box.filter("no % 2 = 1").withColumnRenamed("no", "object_no").drop("text")
    return objects, box.filter("no % 2 = 0").withColumnRenamed("no", "block_no")


@query("figure_captions", "WITH " + GEOMETRY.format(
    word="Figure", window=80, distance="CASE WHEN below BETWEEN 0 AND 80 THEN below ELSE above + 1000 END"))
def figure_captions(spark, folder):
    return CA.figure_captions(*boxes(spark, folder, "Figure"))


@query("table_captions", "WITH " + GEOMETRY.format(
    word="Table", window=60, distance="CASE WHEN above BETWEEN 0 AND 60 THEN above ELSE below END"))
def table_captions(spark, folder):
    return CA.table_captions(*boxes(spark, folder, "Table"))


@query("slugify", r"""
SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'document') AS slug
FROM (SELECT page_id, regexp_replace(name, '(.)\.[^.]*$', '\1') AS stem
      FROM (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS name FROM pages))""")
def slugify(spark, folder):
    return read(spark, folder, "pages").select("page_id", tx.slug_from_path(F.col("url")).alias("slug"))


DOI_FORMS = ("https://doi.org/10.{k}/{k}.x", "DOI: 10.{k}/p-{k}", "10.{k}/A b", "http://dx.doi.org/10.{k}", "{k}")


@query("doi_normalize", r"""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'https://doi.org/10.' || k || '/' || k || '.x'
             WHEN 1 THEN 'DOI: 10.' || k || '/p-' || k WHEN 2 THEN '10.' || k || '/A b'
             WHEN 3 THEN 'http://dx.doi.org/10.' || k ELSE k END AS raw
           FROM (SELECT o_orderkey, (o_orderkey + 900)::VARCHAR AS k FROM orders)),
s AS (SELECT o_orderkey, nullif(regexp_extract(trim(regexp_replace(regexp_replace(raw, '(?i)^https?://(dx\.)?doi\.org/', ''), '(?i)^doi:\s*', '')),
             '(?i)^(10\.\d{4,9}/\S+)', 1), '') AS doi FROM r)
SELECT o_orderkey, doi, coalesce(nullif(trim(regexp_replace(doi, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), CASE WHEN doi IS NULL THEN 'fetched' END) AS slug FROM s""")
def doi_normalize(spark, folder):
    k = (F.col("o_orderkey") + 900).cast("string")
    raw = F.lit(None).cast("string")
    for i, form in enumerate(DOI_FORMS):
        head, *rest = form.split("{k}")
        parts = [F.lit(head)]
        for piece in rest:
            parts += [k, F.lit(piece)]
        raw = F.when(F.col("o_orderkey") % 5 == i, F.concat(*parts)).otherwise(raw)
    doi = read(spark, folder, "orders").select("o_orderkey", tx.normalize_doi(raw).alias("doi"))
    return doi.withColumn("slug", tx.doi_slug(F.col("doi")))


@query("artifact_ids", r"""
WITH a AS (SELECT 'd-' || l_orderkey || CASE l_returnflag WHEN 'A' THEN '-t' WHEN 'R' THEN '-f' ELSE '-x' END || l_linenumber AS id FROM lineitem)
SELECT id, regexp_extract(id, '^(.+)-([tfe])(\d+)$', 1) AS doc_id, regexp_extract(id, '^(.+)-([tfe])(\d+)$', 2) AS kind,
       regexp_extract(id, '^(.+)-([tfe])(\d+)$', 3) AS number FROM a""")
def artifact_ids(spark, folder):
    mark = F.when(F.col("l_returnflag") == "A", "-t").when(F.col("l_returnflag") == "R", "-f").otherwise("-x")
    ids = read(spark, folder, "lineitem").select(
        F.concat(F.lit("d-"), F.col("l_orderkey").cast("string"), mark, F.col("l_linenumber").cast("string")).alias("id")
    )
    return ids.select("id", A.artifact_key(F.col("id")).alias("k")).select("id", "k.*")


@query("table_text", """
SELECT doc_id, trim(concat_ws(chr(10), nullif(caption, ''), nullif(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
         lambda l: array_to_string(list_filter(string_split(l, ' '), lambda c: c <> ''), ' | ')), lambda r: r <> ''), chr(10)), ''))) AS text
FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS caption FROM documents)""")
def table_text(spark, folder):
    """A document's lines as table rows, its words as cells."""
    docs = spread(read(spark, folder, "documents").select("doc_id", "lang", "text"))
    cells = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    caption = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return docs.select("doc_id", tx.table_text(caption, cells).alias("text"))
