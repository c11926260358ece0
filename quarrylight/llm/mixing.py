"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import BROADCAST_ROWS, bounded_count, broadcast_within, spill

WEIGHTS = (5, 2, 1)
# The mix as a share of all words, and the most often a source's words may be taken.
SHARE = (3, 2)
MOST = 2
SEED = 17
# Draws with different seeds; each source keeps the one that comes nearest its target.
DRAWS = 16

_GAP = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than white space (space, tab to carriage return); null has 0."""
    parts = F.size(F.split(text, _GAP)).cast("long")
    lead = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    trail = F.when(text.rlike("[\\x20\\x09-\\x0D]\\z"), 1).otherwise(0)
    return F.when(text.rlike("[^\\x20\\x09-\\x0D]"), parts - lead - trail).otherwise(F.lit(0)).cast("long")


def targets(
    sizes: DataFrame, source: str, size: str, weights: Sequence[int] = WEIGHTS, share=SHARE, most: int = MOST
) -> DataFrame:
    """``sizes`` (a row per source) with ``target``, the words the mix is to take of it.

    Sources in order of code point (null last) take the weights in turn. The mix has
    ``share`` of all words; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight. The level at which a source stops is its cap over
    its weight, so one pass in that order finds the common level of the others. This is a
    table of sources, a dimension of the corpus, not of documents.
    """
    order = W.orderBy(F.col(source).isNull(), F.col(source).cast("binary"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (turn + 1).cast("int"))
    every = W.partitionBy(F.lit(1))
    level = W.orderBy("__stop", F.col(source).isNull(), F.col(source).cast("binary"))
    before = level.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("__w", weight)
        .withColumn("__cap", (F.col(size) * most).cast("long"))
        .withColumn("__stop", F.col("__cap") / F.col("__w"))
        .withColumn("__all", F.sum(size).over(every))
        .withColumn("__stopped", F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__open", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__rise", (F.col("__all") * share[0] / share[1] - F.col("__stopped")) / F.col("__open"))
    )
    # up to that level the rise grows from source to source, beyond it falls
    free = F.max(F.when(F.col("__stop") > F.col("__rise"), F.col("__rise"))).over(every)
    target = F.when(F.col("__stop") <= F.coalesce(free, F.col("__stop")), F.col("__cap").cast("double")).otherwise(
        free * F.col("__w")
    )
    return ranked.withColumn("target", target).select(*sizes.columns, "target")


def _unit(key: Column, seed: int, draw: Column) -> Column:
    """Hash of a key as a number from 0 up to 1 in 52 bits."""
    text = F.concat_ws("-", F.lit(str(seed)), draw.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _sources(sized: DataFrame, weights, share, most: int, seed: int, draws: int) -> DataFrame:
    """A row per source: ``source``, ``source_size``, ``target``, ``rate`` and the number of its ``draw``."""
    rates = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source", "source_size", weights, share, most
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rates = spill(rates.select(F.col("source").alias("s"), "source_size", "target", "rate"), "rates")
    rated = _with_source(sized, "source", rates)
    part = F.col("rate") - F.floor("rate")
    extra = [
        F.sum(F.when(_unit(F.col("id"), seed, F.lit(n)) < part, F.col("size")).otherwise(0)).alias(f"x{n}")
        for n in range(draws)
    ]
    whole = F.floor("rate") * F.col("source_size")
    gaps = [
        F.struct(F.abs(whole + F.col(f"x{n}") - F.col("target")).alias("gap"), F.lit(n).alias("draw"))
        for n in range(draws)
    ]
    totals = rated.groupBy("s", "source_size", "target", "rate").agg(*extra)
    return spill(
        totals.select("s", "source_size", "target", "rate", F.array_min(F.array(*gaps))["draw"].alias("draw")), "draws"
    )


def _with_source(rows: DataFrame, column: str, sources: DataFrame) -> DataFrame:
    """Rows with their source's figures; the sources are broadcast if a count shows that they are few."""
    side = broadcast_within(sources, bounded_count(sources, BROADCAST_ROWS))
    return rows.join(side, rows[column].eqNullSafe(side["s"]))


def _copies(key: Column, seed: int, rate: str = "rate", draw: str = "draw") -> Column:
    part = F.col(rate) - F.floor(rate)
    return (F.floor(rate) + F.when(_unit(key, seed, F.col(draw)) < part, 1).otherwise(0)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return spill(
        docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size")),
        "sizes",
    )


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    most: int = MOST,
    seed: int = SEED,
    draws: int = DRAWS,
) -> DataFrame:
    """A row per row of ``docs``: id, source, ``size``, ``source_size``, ``target``, ``copies``.

    A source's rate is its target over its size. Every document is taken floor(rate) times,
    and once more if the hash of its id and the seed falls below the rate's fraction. Of
    ``draws`` seeds each source uses the one whose total comes nearest its target (the
    first of equals); their totals come from one aggregate that is combined before its
    shuffle, so a source with very many documents is not gathered anywhere. Null texts
    have size 0, null sources are a source of their own, null ids hash as the empty text,
    repeated rows are taken alike. A source without words has target 0 and no copies.
    Columns beside the three are ignored. An empty table gives an empty result.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    rated = _with_source(sized, "source", _sources(sized, weights, share, most, seed, draws))
    return rated.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        _copies(F.col("id"), seed).alias("copies"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    most: int = MOST,
    seed: int = SEED,
    draws: int = DRAWS,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_plan` says, all columns kept.

    Texts are not shuffled: the documents meet the table of sources in place. Cases are
    defined as in :func:`mix_plan`.
    """
    figures = _sources(_sized(docs, id_col, text_col, source_col), weights, share, most, seed, draws)
    figures = figures.select("s", F.col("rate").alias("__mix_rate"), F.col("draw").alias("__mix_draw"))
    side = broadcast_within(figures, bounded_count(figures, BROADCAST_ROWS)).withColumnRenamed("s", "__mix_source")
    rated = docs.join(side, docs[source_col].eqNullSafe(side["__mix_source"]))
    times = _copies(docs[id_col], seed, "__mix_rate", "__mix_draw")
    taken = rated.withColumn("__mix_copies", times).where("__mix_copies > 0")
    copies = taken.withColumn("__mix_turn", F.explode(F.sequence(F.lit(1).cast("long"), "__mix_copies")))
    return copies.drop(*side.columns, "__mix_copies", "__mix_turn")
