"""Column expressions over text: tokens, in-row counts, keywords, slugs, digests.

The counting helpers work inside one row with array functions, so keyword
extraction and term frequencies need no shuffle: a text is always held whole by
one row, and the counts of one text never leave its task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def word_tokens(text: Column, drop: Iterable[str] = ()) -> Column:
    """Lower-cased words of ``text`` in reading order, without the words in ``drop``."""
    words = F.transform(F.regexp_extract_all(text, F.lit(fixed.WORD_PATTERN), F.lit(0)), F.lower)
    stop = sorted(set(drop))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return F.coalesce(words, F.array().cast("array<string>"))


def search_tokens(text: Column) -> Column:
    """Every word of ``text`` in reading order, lower-cased, of any script and length."""
    words = F.transform(F.regexp_extract_all(text, F.lit(fixed.SEARCH_PATTERN), F.lit(0)), F.lower)
    return F.coalesce(words, F.array().cast("array<string>"))


def with_term_counts(
    df: DataFrame, text: str, out: str = "terms", drop: Iterable[str] = fixed.KEYWORD_STOP,
    search: bool = False,
) -> DataFrame:
    """Add ``out``: array of ``(term, n, first_pos)``, one entry per distinct word.

    Words are those of keywords without the ones in ``drop``, or with ``search`` all search words.

    Words are sorted with their position, then every run of equal words becomes
    one entry. The steps are separate projections so that each array is built once.
    Explode the result with ``explode_outer``: the size filter that Spark derives
    for ``explode`` is pushed below these projections and would repeat them.
    """
    keep = [c for c in df.columns if c != out]
    tokens = search_tokens(F.col(text)) if search else word_tokens(F.col(text), drop)
    words = df.select(*keep, tokens.alias("_words"))
    placed = words.select(
        *keep,
        F.array_sort(
            F.transform("_words", lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
        ).alias("_sorted"),
    )
    starts = placed.select(
        *keep,
        "_sorted",
        F.filter(
            F.transform(
                "_sorted",
                lambda x, i: F.when(
                    (i == 0) | (x["term"] != F.col("_sorted")[F.greatest(i - 1, F.lit(0))]["term"]), i
                ),
            ),
            lambda i: i.isNotNull(),
        ).alias("_starts"),
    )
    return starts.select(
        *keep,
        F.transform(
            "_starts",
            lambda s, j: F.struct(
                F.col("_sorted")[s]["term"].alias("term"),
                (
                    F.coalesce(F.get(F.col("_starts"), j + 1), F.size("_sorted")) - s
                ).alias("n"),
                F.col("_sorted")[s]["pos"].alias("first_pos"),
            ),
        ).alias(out),
    )


def top_terms(terms: Column, n: int) -> Column:
    """The ``n`` most frequent entries, ties by first appearance, as an array of words."""
    ranked = F.array_sort(
        F.transform(
            terms,
            lambda t: F.struct(
                (-t["n"]).alias("neg"), t["first_pos"].alias("pos"), t["term"].alias("term")
            ),
        )
    )
    return F.transform(F.slice(ranked, 1, n), lambda t: t["term"])


def with_keywords(
    df: DataFrame, text: str, n: int, out: str = "keywords",
    drop: Iterable[str] = fixed.KEYWORD_STOP,
) -> DataFrame:
    """Add ``out``: the top ``n`` keywords of ``text`` in rank order."""
    counted = with_term_counts(df, text, "_terms", drop)
    return counted.withColumn(out, top_terms(F.col("_terms"), n)).drop("_terms")


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def digest16(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def slug_from_path(path: Column) -> Column:
    """File name without directory and suffix as a lower-case, dash-separated slug."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    slug = F.regexp_replace(F.lower(stem), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, r"^-+|-+$", "")
    return F.coalesce(blank_to_null(slug), F.lit("document"))


def normalize_doi(raw: Column) -> Column:
    """Bare DOI inside a DOI URL or ``doi:`` string, else null."""
    s = F.trim(raw)
    s = F.regexp_replace(s, r"(?i)^https?://(dx\.)?doi\.org/", "")
    s = F.trim(F.regexp_replace(s, r"(?i)^doi:\s*", ""))
    return blank_to_null(F.regexp_extract(s, fixed.DOI_PATTERN, 1))


def doi_slug(doi: Column) -> Column:
    """File-name-safe form of a DOI."""
    s = F.regexp_replace(doi, r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(blank_to_null(F.regexp_replace(s, r"^_+|_+$", "")), F.lit("fetched"))


def ascii_only(text: Column) -> Column:
    """Console-safe text: every non-ASCII character becomes a question mark."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", "?")


def table_text(caption: Column, cells: Column) -> Column:
    """Caption and non-empty cells of a table as searchable text."""
    rows = F.transform(
        F.coalesce(cells, F.array().cast("array<array<string>>")),
        lambda r: F.array_join(F.filter(r, lambda c: c.isNotNull() & (c != "")), " | "),
    )
    parts = F.concat(F.array(F.coalesce(caption, F.lit(""))), rows)
    return F.trim(F.array_join(F.filter(parts, lambda p: p != ""), "\n"))


def noise_ratio(text: Column) -> Column:
    """Share of non-space characters that are control, replacement or OCR junk."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", "")
    clean = F.regexp_replace(solid, f"[{fixed.NOISE_CLASS}]", "")
    n = F.length(solid)
    return F.when(n == 0, F.lit(0.0)).otherwise((n - F.length(clean)) / n)


def formula_signs(line: Column) -> Column:
    """Struct ``(numbered, related, dense)``: the three signs of an equation line."""
    s = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"^(?U)\s+|(?U)\s+$", ""))
    solid = F.regexp_replace(s, r"(?U)\s", "")
    symbols = F.length(solid) - F.length(F.regexp_replace(solid, f"[{fixed.MATH_CLASS}]", ""))
    return F.struct(
        s.rlike(fixed.EQUATION_NUMBER_PATTERN).alias("numbered"),
        s.rlike(fixed.RELATION_PATTERN).alias("related"),
        (symbols / F.greatest(F.length(solid), F.lit(1)) >= fixed.FORMULA_DENSITY).alias("dense"),
    )


def is_formula(line: Column) -> Column:
    """Equation-like line: at least two of equation number, relation and symbol density."""
    long_enough = F.length(F.trim(F.coalesce(line, F.lit("")))) >= fixed.FORMULA_MIN_CHARS
    signs = formula_signs(line)
    numbered, related, dense = signs["numbered"], signs["related"], signs["dense"]
    return long_enough & ((numbered & (related | dense)) | (dense & related))


def has_scanner_signature(producer: Column, creator: Column) -> Column:
    blob = F.lower(
        F.concat_ws(" ", F.coalesce(producer, F.lit("")), F.coalesce(creator, F.lit("")))
    )
    hit = F.lit(False)
    for mark in fixed.SCANNER_SIGNATURES:
        hit = hit | blob.contains(mark)
    return hit


def lexical_scope(query: Column) -> Column:
    """Struct ``(scope, strength)`` from marker words; a tie is local with strength 0."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(query, F.lit(""))), F.lit(" "))

    def hits(markers: Iterable[str]) -> Column:
        total = F.lit(0)
        for m in markers:
            total = total + padded.contains(m).cast("int")
        return total

    lead = hits(fixed.GLOBAL_MARKERS) - hits(fixed.LOCAL_MARKERS)
    return F.struct(
        F.when(lead > 0, F.lit("global")).otherwise(F.lit("local")).alias("scope"),
        F.abs(lead).alias("strength"),
    )
