"""Native or scanned: page labels, document votes and trait summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed
from ..functions.text import has_scanner_signature, noise_ratio


def page_label(coverage: Column, n_chars: Column, noise: Column, n_fonts: Column) -> Column:
    scanned = (coverage >= fixed.SCAN_COVERAGE) | ((coverage >= fixed.AMBIGUOUS_COVERAGE) & (n_fonts <= 1))
    readable = (n_chars >= fixed.TEXT_USABLE_CHARS) & (noise < fixed.NOISE_LIMIT)
    return F.when(~scanned, "native").when(readable, "scan-ocr").otherwise("scan-image")


def confidence(scanned: Column, scan_fraction: Column, signature: Column) -> Column:
    """Confidence in [0, 1]; metadata can only confirm or weaken the coverage vote."""
    share = F.when(scanned, scan_fraction).otherwise(1.0 - scan_fraction)
    excess = F.greatest(F.lit(0.0), (share - 0.5) / 0.5)
    bonus = F.when(scanned == signature, F.lit(0.20)).otherwise(F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 + 0.25 * excess + bonus)), 4)


def sampled_pages(n_pages: Column) -> Column:
    """Zero-based page numbers looked at: all of a short document, else evenly spaced."""
    n = fixed.MAX_SAMPLED_PAGES
    spaced = F.array_distinct(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (n_pages / n)).cast("int"))
    )
    every = F.when(n_pages > 0, F.sequence(F.lit(0), n_pages - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n_pages <= n, every).otherwise(spaced)


def sample(pages: DataFrame) -> DataFrame:
    """Pages (numbered from 1) of the sample, with ``n_pages`` of their document."""
    counts = pages.groupBy("doc_id").agg(F.count_distinct("page").cast("int").alias("n_pages"))
    return pages.join(counts, "doc_id").filter(
        F.array_contains(sampled_pages(F.col("n_pages")), F.col("page") - 1)
    )


def image_coverage(images: DataFrame, pages: DataFrame) -> DataFrame:
    """``(doc_id, page, coverage)``: image area over page area in [0, 1]."""
    area = images.groupBy("doc_id", "page").agg(
        F.sum(F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("area")
    )
    whole = F.abs(F.col("width") * F.col("height"))
    share = F.coalesce("area", F.lit(0.0)) / whole
    return pages.join(area, ["doc_id", "page"], "left").select(
        "doc_id", "page",
        F.when(whole <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).alias("coverage"),
    )


def column_guess(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``(doc_id, page, col_guess)``: two columns when enough blocks start in the right half."""
    counted = blocks.join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]).groupBy("doc_id", "page").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("x0") / F.when(F.col("width") == 0, 1.0).otherwise(F.abs("width")) > 0.5).alias("right"),
    )
    two = (F.col("n") >= 4) & (F.col("right") >= F.greatest(F.lit(2), F.floor(F.col("n") / 4)))
    return pages.select("doc_id", "page").join(counted, ["doc_id", "page"], "left").select(
        "doc_id", "page", F.when(F.coalesce(two, F.lit(False)), 2).otherwise(1).alias("col_guess")
    )


def with_text_traits(pages: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_chars`` and ``noise`` of the page text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^(?U)\s+|(?U)\s+$", "")
    return pages.withColumns({"n_chars": F.length(trimmed), "noise": noise_ratio(F.col(text))})


def classify_documents(traits: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Document class and evidence from page traits.

    ``traits`` holds ``(doc_id, page, n_pages, coverage, n_chars, noise, n_fonts, col_guess)``
    of the sampled pages, ``info`` the documents' ``(doc_id, producer, creator)``.
    The first page has no vote when the document has three or more pages and more
    than one was sampled.
    """
    labelled = traits.withColumn(
        "label", page_label(F.col("coverage"), F.col("n_chars"), F.col("noise"), F.col("n_fonts"))
    )
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("page")) == 1
    sampled = F.count("*").over(W.partitionBy("doc_id"))
    voting = labelled.withColumn(
        "votes", ~(first & (F.col("n_pages") >= 3) & (sampled > 1))
    )
    vote = lambda label: F.count_if(F.col("votes") & (F.col("label") == label))
    r4 = lambda c: F.round(F.avg(c), 4)
    summary = voting.groupBy("doc_id").agg(
        F.max("n_pages").alias("n_pages"),
        r4("coverage").alias("image_coverage"),
        F.bool_or(F.col("n_chars") >= fixed.TEXT_PRESENT_CHARS).alias("has_text_layer"),
        F.count_if("votes").alias("n_votes"),
        vote("scan-ocr").alias("n_ocr"),
        vote("scan-image").alias("n_image"),
        r4("n_chars").alias("mean_text_chars"),
        r4("noise").alias("mean_noise_ratio"),
        r4("n_fonts").alias("mean_fonts"),
        F.count_if(F.col("col_guess") == 2).alias("two"),
        F.count_if(F.col("col_guess") == 1).alias("one"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("page", "label"))), lambda p: p["label"]
        ).alias("page_labels"),
    )
    blank = F.lit("").cast("string")
    known = (
        summary.join(info.select("doc_id", "producer", "creator"), "doc_id", "full")
        if info is not None
        else summary.withColumns({"producer": blank, "creator": blank})
    )
    votes = F.coalesce("n_votes", F.lit(0))
    raw = F.when(votes == 0, F.lit(0.0)).otherwise((F.col("n_ocr") + F.col("n_image")) / votes)
    graded = known.withColumns(
        {
            "producer": F.coalesce("producer", F.lit("")),
            "creator": F.coalesce("creator", F.lit("")),
            "_votes": votes,
            "_raw": raw,
        }
    ).withColumn("meta_ocr_signature", has_scanner_signature(F.col("producer"), F.col("creator")))
    scanned = F.col("_raw") >= 0.5
    return graded.select(
        "doc_id",
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"),
        F.coalesce("image_coverage", F.lit(0.0)).alias("image_coverage"),
        F.coalesce("has_text_layer", F.lit(False)).alias("has_text_layer"),
        F.when(F.coalesce(F.col("two") > F.col("one"), F.lit(False)), 2).otherwise(1).alias("col_count_guess"),
        scanned.alias("looks_scanned"),
        F.when(~scanned, "pdf-native").when(F.col("n_ocr") >= F.col("n_image"), "pdf-scan-ocr")
        .otherwise("pdf-scan-image").alias("source_class"),
        F.when(F.col("_votes") == 0, F.lit(0.0))
        .otherwise(confidence(scanned, F.col("_raw"), F.col("meta_ocr_signature"))).alias("source_confidence"),
        F.when(scanned, "pdf-scan").otherwise("pdf-native").alias("route"),
        F.struct(
            F.round("_raw", 4).alias("scan_fraction"), "meta_ocr_signature", "producer", "creator",
            F.coalesce("page_labels", F.array().cast("array<string>")).alias("page_labels"),
            F.coalesce("mean_text_chars", F.lit(0.0)).alias("mean_text_chars"),
            F.coalesce("mean_noise_ratio", F.lit(0.0)).alias("mean_noise_ratio"),
            F.coalesce("mean_fonts", F.lit(0.0)).alias("mean_fonts"),
            F.struct(
                F.lit(fixed.SCAN_COVERAGE).alias("fullpage_cov"),
                F.lit(fixed.TEXT_USABLE_CHARS).alias("text_usable"),
                F.lit(fixed.NOISE_LIMIT).alias("noise"),
            ).alias("thresholds"),
        ).alias("signals"),
    )


def wants_ocr(source_class: Column) -> Column:
    """Whether a structural parser should run character recognition."""
    return source_class.isin("pdf-scan-ocr", "pdf-scan-image")
