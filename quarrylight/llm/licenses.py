"""License scan of whole texts by ordered signature rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .license_rules import BASE, CONFIDENCE, Rule, rules

# Characters that separate words: all ASCII but digits and letters.
_GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def plain_text(text: Column) -> Column:
    """Words joined by single spaces, in their own case; null is empty."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), _GAP, " "))


def _count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _rule_table(found: Sequence[Rule]) -> Column:
    return F.array(*[
        F.struct(F.lit(r.number).alias("number"), F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex"))
        for r in found
    ])


def _by_number(found: Sequence[Rule], value) -> Column:
    return F.element_at(F.array(*[F.lit(value(r)) for r in found]), F.col("det.number") + 1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(plain: Column, rule: Column) -> Column:
    """(rule, turn, characters since its last place, own length) of all places of one rule."""
    cut = F.struct(
        F.split(plain, rule["regex"]).alias("gaps"), F.regexp_extract_all(plain, rule["regex"], F.lit(0)).alias("hits")
    )
    return _let(cut, lambda x: F.transform(
        x["hits"],
        lambda hit, k: F.struct(
            rule["number"].alias("number"), k.alias("turn"), F.length(F.get(x["gaps"], k)).alias("gap"), F.length(hit).alias("size")
        ),
    ))


def _detections(plain: Column, found: Sequence[Rule]) -> Column:
    """All places of all rules whose keyword stands in the text."""
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in found})])

    def of(text: Column) -> Column:
        held = _let(F.lower(text), lambda low: F.filter(keywords, lambda k: F.contains(low, k)))
        tried = _let(held, lambda have: F.filter(_rule_table(found), lambda r: F.array_contains(have, r["keyword"])))
        return F.flatten(F.transform(F.filter(tried, lambda r: F.rlike(text, r["regex"])), lambda r: _places(text, r)))

    return _let(plain, of)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: Sequence[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, base places and the labels of all rules.

    Columns: ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``,
    ``score`` and ``spans`` (start, end, label of the detections that stay, in characters of
    :func:`plain_text`, sorted).

    A rule is tried on texts that hold its keyword. Of the places found, one that overlaps
    a place of a better class is suppressed, and so is one that lies in another of its
    class (of equal intervals the earlier rule's stays). ``score`` is the largest confidence
    of what stays, else 0. Texts never leave their task: only places (numbers) are
    shuffled, one row or more per document, by a row number of their own, so equal ids and
    repeated rows stay apart and a text with very many places is one sort in one task.

    Null and empty texts have 0 words, null places, empty labels and score 0. Columns beside
    the two are ignored. An empty table gives an empty result.
    """
    found = list(found or rules())
    texts = docs.select(F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("plain"))
    padded = F.concat(F.lit(" "), "plain", F.lit(" "))
    places = "|".join(phrase for phrase, _ in BASE)
    base = texts.select(
        "id", "plain", F.split(padded, f"(?i) (?=(?:{places}) )").alias("parts")
    ).withColumn("n_base", (F.size("parts") - 1).cast("long"))
    n_words = F.when(F.col("plain") == "", 0).otherwise(_count_of(F.col("plain"), " ") + 1).cast("long")
    flags = [F.when(F.col("plain").rlike(f"(?i)(?<![^ ]){phrase}(?![^ ])"), label) for phrase, label in BASE]
    none = F.array().cast("array<string>")
    listed = base.select(
        F.monotonically_increasing_id().alias("row"), "id", n_words.alias("n_words"), "n_base",
        F.when(F.col("n_base") > 0, _count_of(F.get("parts", F.lit(0)), " ")).cast("long").alias("first_word"),
        F.when(F.col("n_base") > 0, n_words - _count_of(F.element_at("parts", -1), " ")).cast("long").alias("last_word"),
        F.when(F.col("n_base") > 0, F.array_compact(F.array(*flags))).otherwise(none).alias("base"),
        _detections(F.col("plain"), found).alias("dets"),
    )
    whole = ["row", "id", "n_words", "n_base", "first_word", "last_word", "base"]
    rows = listed.select(*whole, F.explode_outer("dets").alias("det"))
    each = W.partitionBy("row", "det.number").orderBy("det.turn")
    end = F.sum(F.col("det.gap") + F.col("det.size")).over(each)
    placed = rows.select(
        *whole, (end - F.col("det.size")).alias("start"), end.alias("end"), F.col("det.number").alias("number"),
        _by_number(found, lambda r: r.label).alias("label"), _by_number(found, lambda r: r.grade).alias("grade"),
    )
    order = W.partitionBy("row").orderBy("start", F.desc("end"), "grade", "number")
    # The rows behind a place come from the opposite order, as Spark sums a frame from the start on in one pass.
    back = W.partitionBy("row").orderBy(F.desc("start"), "end", F.desc("grade"), F.desc("number"))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), back.rowsBetween(W.unboundedPreceding, -1)
    grades = sorted(CONFIDENCE)

    def pick(of) -> Column:
        out = F.lit(None)
        for g in grades:
            out = F.when(F.col("grade") == g, of(g)).otherwise(out)
        return out

    marks = placed.select(
        "*",
        pick(lambda g: F.max(F.when(F.col("grade") < g, F.col("end"))).over(before)).alias("better_end"),
        pick(lambda g: F.min(F.when(F.col("grade") < g, F.col("start"))).over(after)).alias("better_start"),
        pick(lambda g: F.max(F.when(F.col("grade") == g, F.col("end"))).over(before)).alias("same_end"),
    )
    stays = F.col("number").isNotNull() & ~(
        F.coalesce(F.col("better_end") > F.col("start"), F.lit(False))
        | F.coalesce(F.col("better_start") < F.col("end"), F.lit(False))
        | F.coalesce(F.col("same_end") >= F.col("end"), F.lit(False))
    )
    kept = marks.withColumn("stays", stays).withColumn(
        "confidence", F.element_at(F.array(*[F.lit(CONFIDENCE[g]) for g in grades]), F.col("grade"))
    )
    span = F.when(F.col("stays"), F.struct(
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("label").alias("label")
    ))
    out = kept.groupBy(*whole).agg(
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.collect_set(F.when(F.col("stays"), F.col("label"))).alias("found"),
        F.max(F.when(F.col("stays"), F.col("confidence"))).alias("confidence"),
    )
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"), joined(F.array_union("base", "found")).alias("labels"),
        F.coalesce("confidence", F.lit(0.0)).alias("score"), "spans",
    )
