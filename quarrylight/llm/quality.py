"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_within, discard, spill
from .words import quoted

# Most labelled documents that a classifier is fitted on; of unlabelled ones all take part.
FIT_ROWS = 10_000
ROUNDS = 3
# A view hands a document to the other one if it is at least so sure of its class.
SURE = 0.98
KEEP = 0.5
TEXT_BITS = 17
META_BITS = 12
SEED = 5
# One labelled document in so many calibrates the views and is not fitted on.
HELD_OUT = 4
META_COLUMNS = ("source", "lang")


def _text_tokens(words: Column) -> Column:
    """Runs of letters, digits and other signs in lower case, and the shapes of the words, of an array of words.

    Neither spans white space, so those of a text's distinct words are those of the text.
    """
    text = F.array_join(words, " ")
    runs = F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+|\\p{N}+|[^\\p{L}\\p{N}\\s]+"), F.lit(0))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\p{Lu}+", "A"), "[\\p{L}&&[^A]]+", "a"), "\\p{N}+", "0")
    shapes = F.array_distinct(F.split(shape, "\\s+"))
    return F.concat(F.array_distinct(runs), F.transform(shapes, lambda s: F.concat(F.lit("shape "), F.substring(s, 1, 12))))


def _page_figures(text: Column, words: Column, distinct: Column, signs: Column) -> dict[str, Column]:
    """Layout figures of a page, of its words and of what is left of it without letters."""
    chars = F.greatest(F.length(text), F.lit(1))
    less = lambda whole, pattern: F.length(whole) - F.length(F.regexp_replace(whole, f"{pattern}+", ""))
    lines = F.split(text, "\n")
    return {
        "chars": F.log1p(F.length(text).cast("double")),
        "lines": F.log1p(F.size(lines).cast("double")),
        "line_length": F.log1p(chars / F.size(lines)),
        "line_repeats": F.lit(1.0) - F.size(F.array_distinct(lines)) / F.size(lines),
        "word_variety": F.size(distinct) / F.sqrt(F.size(words).cast("double")),
        "word_length": chars / F.size(words),
        "upper": less(text, "\\p{Lu}") / chars,
        "digits": less(signs, "\\p{N}") / chars,
        "letters": (F.length(text) - F.length(signs)) / chars,
        "space": less(signs, "\\s") / chars,
    }


def with_views(docs: DataFrame, text_col: str = "text", meta_columns: Sequence[str] = META_COLUMNS) -> DataFrame:
    """``docs`` with the vectors ``__q_text`` and ``__q_meta``; null texts and metadata count as empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.withColumn("__q_body", text).withColumns({
        "__q_words": F.split("__q_body", "\\s+"), "__q_signs": F.regexp_replace("__q_body", "\\p{L}+", ""),
    })
    rows = rows.withColumn("__q_distinct", F.array_distinct("__q_words"))
    parts = (F.col(f"__q_{c}") for c in ("body", "words", "distinct", "signs"))
    figures = {f"__q_{k}": v for k, v in _page_figures(*parts).items()}
    groups = {f"__q_{c}": F.coalesce(docs[c].cast("string"), F.lit("")) for c in meta_columns if c in docs.columns}
    rows = rows.withColumns({"__q_tokens": _text_tokens(F.col("__q_distinct")), **figures, **groups})
    hashed = HashingTF(inputCol="__q_tokens", outputCol="__q_counts", numFeatures=1 << TEXT_BITS, binary=True)
    rows = Normalizer(inputCol="__q_counts", outputCol="__q_text").transform(hashed.transform(rows))
    inputs = [*figures, *groups]
    hasher = FeatureHasher(inputCols=inputs, outputCol="__q_meta", categoricalCols=list(groups), numFeatures=1 << META_BITS)
    return hasher.transform(rows).select(*map(quoted, docs.columns), "__q_text", "__q_meta")


@dataclass
class CoTrained:
    """Fitted views with their calibration; ``rate`` alone if there was nothing to fit on."""

    rate: float
    text: LogisticRegressionModel | None = None
    meta: LogisticRegressionModel | None = None
    text_scale: tuple[float, float] = (1.0, 0.0)
    meta_scale: tuple[float, float] = (1.0, 0.0)
    weights: tuple[float, float, float] = (0.5, 0.5, 0.0)

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with both views) with ``__q_by_text``, ``__q_by_meta`` and ``__q_score``, each from 0 to 1."""
        if self.text is None:
            rate = F.lit(float(self.rate))
            return rows.withColumns({"__q_by_text": rate, "__q_by_meta": rate, "__q_score": rate})
        for view, scale in (("text", self.text_scale), ("meta", self.meta_scale)):
            margin = _margin(getattr(self, view).transform(rows), view)
            rows = margin.withColumn(f"__q_{view}_logit", F.lit(scale[0]) * F.col(f"__q_{view}_margin") + F.lit(scale[1]))
        logit = sum(F.lit(w) * F.col(f"__q_{v}_logit") for w, v in zip(self.weights, ("text", "meta"))) + F.lit(self.weights[2])
        return rows.withColumns({
            "__q_by_text": _chance(F.col("__q_text_logit")), "__q_by_meta": _chance(F.col("__q_meta_logit")), "__q_score": _chance(logit),
        })


def _chance(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _margin(scored: DataFrame, view: str) -> DataFrame:
    margin = vector_to_array(F.col("__q_raw"))[1]
    return scored.withColumn(f"__q_{view}_margin", margin).drop("__q_raw", "__q_probability", "__q_prediction")


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(
        featuresCol=f"__q_{view}", labelCol="__q_y", rawPredictionCol="__q_raw", probabilityCol="__q_probability",
        predictionCol="__q_prediction", maxIter=30, tol=1e-4, regParam=1e-4, standardization=view == "meta",
        weightCol="__q_weight",
    ).fit(rows)


def _scale(margins: np.ndarray, good: np.ndarray, pull: float = 1e-3) -> list[float]:
    """Coefficients and intercept of a calibration by held-out labels, with a light pull towards 0.

    ``margins`` has a row per held-out document: numbers of a bounded sample, fitted on the driver by Newton steps.
    """
    inputs = np.column_stack([margins, np.ones(len(margins))])
    weights = np.zeros(inputs.shape[1])
    ridge = pull * np.diag([*np.ones(inputs.shape[1] - 1), 0.0])
    loss = lambda w: np.logaddexp(0, -np.where(good, 1, -1) * (inputs @ w)).mean() + 0.5 * w @ ridge @ w
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(inputs @ weights, -500, 500)))
        slope = inputs.T @ (chance - good) / len(inputs) + ridge @ weights
        bend = (inputs.T * (chance * (1 - chance) + 1e-9)) @ inputs / len(inputs) + ridge
        step = np.linalg.solve(bend, slope)
        while np.abs(step).max() > 1e-9 and loss(weights - step) > loss(weights):
            step = step / 2
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return [float(w) for w in weights]


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """(``__q_id``, ``__q_y``) of at most ``fit_rows`` documents that have a label, by hash of the id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__q_id"))
    known = known.agg(F.min((F.col(label_col) > 0).cast("double")).alias("__q_y"))
    present = known.join(docs.select(F.col(id_col).alias("__q_id")), "__q_id", "left_semi")
    return spill(present.orderBy(F.xxhash64(F.lit(SEED), "__q_id"), "__q_id").limit(fit_rows), "labelled")


def _viewed(
    docs: DataFrame, columns: Sequence[str], chosen: DataFrame, fit_rows: int, id_col: str, text_col: str, meta_columns: Sequence[str]
) -> DataFrame:
    """``columns`` of all documents with ``__q_id``, ``__q_y``, ``__q_order`` and both views, written once for the fit and the scores.

    Those of ``chosen`` have a label in ``__q_y``.
    """
    rows = docs.withColumn("__q_id", docs[id_col]).join(broadcast_within(chosen, fit_rows), "__q_id", "left")
    content = [F.coalesce(rows[c].cast("string"), F.lit("")) for c in dict.fromkeys([text_col, *meta_columns]) if c in docs.columns]
    order = F.when(F.col("__q_y").isNotNull(), F.sha2(F.concat_ws("\n", *content), 256))
    views = with_views(rows.withColumn("__q_order", order), text_col, meta_columns)
    return spill(views.select(*map(quoted, columns), "__q_id", "__q_y", "__q_order", "__q_text", "__q_meta"), "views")


def co_train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    meta_columns: Sequence[str] = META_COLUMNS,
    fit_rows: int = FIT_ROWS,
    rounds: int = ROUNDS,
    sure: float = SURE,
) -> CoTrained:
    """Fits both views on at most ``fit_rows`` labelled documents, chosen by hash of the id, and on all others.

    Each view is a logistic regression, fitted over the cluster. In every round each view
    labels all other documents, and what it is ``sure`` of goes to the other view's training rows,
    where these rows together weigh no more than the labelled ones. A
    held-out part of the labelled documents calibrates each view's margin and then weighs
    the two. A document with several labels takes the lowest; labels without a document and
    null labels are ignored, documents with a null id have no label. Of several rows of a labelled id the
    one with the least digest of text and metadata is fitted on; repeated rows without a label all take part.
    Without labels of both classes in both parts there
    is no model, and every document scores the share of good labels (1 without any).
    """
    chosen = _labelled(docs, labels, id_col, label_col, fit_rows)
    return _co_train(_viewed(docs, [], chosen, fit_rows, id_col, text_col, meta_columns), rounds, sure)


def _co_train(views: DataFrame, rounds: int, sure: float) -> CoTrained:
    """:func:`co_train` on the views of all documents."""
    vectors = ("__q_text", "__q_meta")
    one = views.where("__q_y IS NOT NULL").groupBy("__q_id", "__q_y").agg(F.min_by(F.struct(*vectors), "__q_order").alias("v"))
    held = F.pmod(F.xxhash64(F.lit(SEED + 1), "__q_id"), F.lit(HELD_OUT)) == 0
    rows = spill(one.select("__q_y", "v.*", held.alias("__q_held"), F.lit(1.0).alias("__q_weight")).coalesce(1), "labelled-views")
    pool = views.where("__q_y IS NULL").select("__q_y", *vectors)
    counts = {(r["__q_held"], r["__q_y"]): r["count"] for r in rows.groupBy("__q_held", "__q_y").count().collect()}
    total = sum(counts.values())
    rate = sum(n for (_, y), n in counts.items() if y == 1) / total if total else 1.0
    if len(counts) < 4:
        return CoTrained(rate)
    fitted = ["__q_y", *vectors, "__q_weight"]
    known, proof = rows.where("NOT __q_held").select(fitted), rows.where("__q_held")
    n_known = sum(n for (out, _), n in counts.items() if not out)
    extra = {}
    for turn in range(rounds + 1):
        model = CoTrained(rate, *(_fit(known.union(extra[v]) if v in extra else known, v) for v in ("text", "meta")))
        held = model.score(proof).select("__q_text_margin", "__q_meta_margin", "__q_y").collect()
        margins, good = np.array([r[:2] for r in held]), np.array([r[2] == 1 for r in held])
        model.text_scale, model.meta_scale = (tuple(_scale(margins[:, i : i + 1], good)) for i in (0, 1))
        if turn < rounds:
            labelled = model.score(pool)
            sure_of = {v: (F.col(f"__q_by_{v}") >= sure) | (F.col(f"__q_by_{v}") <= 1 - sure) for v in ("text", "meta")}
            sizes = labelled.agg(*[F.count_if(c).alias(v) for v, c in sure_of.items()]).first()
            for view, other in (("text", "meta"), ("meta", "text")):
                given = labelled.withColumn("__q_y", F.round(F.col(f"__q_by_{view}")))
                weight = F.lit(min(1.0, n_known / max(1, sizes[view])))
                extra[other] = given.where(sure_of[view]).withColumn("__q_weight", weight).select(fitted)
    logits = np.column_stack([margins[:, i] * a + b for i, (a, b) in enumerate((model.text_scale, model.meta_scale))])
    model.weights = tuple(_scale(logits, good))
    return model


def _scored(
    docs: DataFrame, columns: Sequence[str], labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality",
    meta_columns: Sequence[str] = META_COLUMNS, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, sure: float = SURE,
) -> tuple[DataFrame, DataFrame]:
    """``columns`` of all ``docs`` with their scores, and the views that the model was fitted on and that they are made from."""
    chosen = _labelled(docs, labels, id_col, label_col, fit_rows)
    views = _viewed(docs, columns, chosen, fit_rows, id_col, text_col, meta_columns)
    return _co_train(views, rounds, sure).score(views), views


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP,
    columns: Sequence[str] | None = None, **options,
) -> DataFrame:
    """``docs`` with ``quality_score``, ``text_score``, ``meta_score`` (0 to 1) and ``kept`` (score at least ``keep``).

    Whole texts of all rows are scored, without a shuffle. Columns of these names
    in ``docs`` are replaced; ``columns`` names those that are wanted, as all of them are written beside the
    views. Null and empty texts are scored as empty pages; repeated rows get equal
    scores; an empty table gives an empty result.
    """
    new = {"quality_score": "__q_score", "text_score": "__q_by_text", "meta_score": "__q_by_meta"}
    own = [c for c in (docs.columns if columns is None else columns) if c not in {*new, "kept"}]
    scored, _ = _scored(docs, own, labels, id_col, text_col, **options)
    scored = scored.withColumn("__q_kept", F.col("__q_score") >= keep)
    return scored.select(*map(quoted, own), *[F.col(v).alias(k) for k, v in new.items()], F.col("__q_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, with their columns alone.

    They are written to the shared folder, and the views, which take as much again, are deleted.
    """
    scored, views = _scored(docs, docs.columns, labels, id_col, text_col, **options)
    kept = spill(scored.where(F.col("__q_score") >= keep).select(*map(quoted, docs.columns)), "kept-pages", "zstd")
    discard(views)
    return kept
