"""Query routing: local (one source) or global (evidence spread over sources)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import lexical_scope
from ..session import ship_package
from .embed import DEFAULT_MODEL, get_embedder


def exemplar_similarity(
    df: DataFrame, vector: str, local: np.ndarray, glob: np.ndarray
) -> DataFrame:
    """Add ``local_sim`` and ``global_sim``: best cosine to the exemplars of each side.

    The exemplars are a fixed handful of vectors and travel with the function.
    """
    ship_package(df.sparkSession)
    sides = {"local_sim": _unit(local), "global_sim": _unit(glob)}

    @F.pandas_udf("local_sim double, global_sim double")
    def best(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({name: pd.Series(dtype=float) for name in sides})
        q = _unit(np.stack(vectors.to_numpy()).astype(np.float64))
        return pd.DataFrame({name: (q @ side.T).max(axis=1) for name, side in sides.items()})

    return df.withColumn("_sim", best(F.col(vector))).select("*", "_sim.*").drop("_sim")


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    size[size == 0] = 1.0
    return m / size


def decide_scope(df: DataFrame, question: str, margin: float) -> DataFrame:
    """Add ``scope``, ``method`` and ``route_score`` from similarities and markers.

    The exemplar vote counts when its margin is wide enough; otherwise, or when a
    similarity is missing, the marker words decide.
    """
    lead = F.col("global_sim") - F.col("local_sim")
    voted = F.coalesce(F.abs(lead) >= margin, F.lit(False))
    lex = df.withColumn("_lex", lexical_scope(F.col(question)))
    return lex.select(
        *df.columns,
        F.when(voted, F.when(lead > 0, F.lit("global")).otherwise(F.lit("local")))
        .otherwise(F.col("_lex.scope"))
        .alias("scope"),
        F.when(voted, F.lit("exemplar")).otherwise(F.lit("lexical")).alias("method"),
        F.when(voted, F.round(lead, 4))
        .otherwise(F.col("_lex.strength").cast("double"))
        .alias("route_score"),
    )


def classify_queries(
    queries: DataFrame, model: str = DEFAULT_MODEL, margin: float = 0.03,
    local: Sequence[str] = fixed.LOCAL_EXEMPLARS, glob: Sequence[str] = fixed.GLOBAL_EXEMPLARS,
) -> DataFrame:
    """Route every query row that carries ``question`` and ``vector``."""
    try:
        engine = get_embedder(model)
        near = exemplar_similarity(
            queries, "vector", engine.encode(list(local)), engine.encode(list(glob))
        )
    except Exception:  # any failure of the embedder leaves the lexical route
        near = queries.withColumns(
            {"local_sim": F.lit(None).cast("double"), "global_sim": F.lit(None).cast("double")}
        )
    return decide_scope(near, "question", margin).drop("local_sim", "global_sim")
