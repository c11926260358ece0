"""The evaluation run: probes, one batch search, scores, strata, decision, report."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..evaluation.metrics import (
    decision, one_row, probe_classes, probe_scores, recall_deltas, stratified, stratum_flag,
)
from ..evaluation.experiments import ids_found
from ..evaluation.probes import generate_probes
from ..recipe import EvalSettings, SearchSettings
from ..session import spill
from .index import CorpusIndex


@dataclass(frozen=True)
class EvalRun:
    k: int
    route: bool
    per_probe: DataFrame
    cells: DataFrame


def run_eval(
    index: CorpusIndex, doc_sources: DataFrame, settings: EvalSettings | None = None,
    search: SearchSettings | None = None, top_k: int | None = None, route: bool = False,
) -> EvalRun:
    """Score the retriever on generated probes.

    With ``route`` the router chooses the width of each query; gold is the same in
    both modes. Probes are few by construction and written once.
    """
    settings, search = settings or EvalSettings(), search or SearchSettings()
    k = top_k or settings.top_k
    probes = spill(generate_probes(index, settings.n_local, k), "probes")
    found = ids_found(index, probes, None if route else k, route, search)
    classes = probe_classes(probes, index.table("terms").select("chunk_id", "doc_id"), doc_sources)
    per_probe = spill(
        probe_scores(probes, found)
        .join(classes, "id", "left")
        .select("id", "scope", F.coalesce("doc_class", F.lit("unknown")).alias("doc_class"),
                "n_gold", F.coalesce("n_scan_gold", F.lit(0)).alias("n_scan_gold"),
                "recall", "hit", "rr"),
        "per_probe",
    )
    return EvalRun(k, route, per_probe, stratified(per_probe))


def compare_routing(off: EvalRun, on: EvalRun) -> DataFrame:
    return recall_deltas(off.cells, on.cells)


def decide(cells: DataFrame, settings: EvalSettings | None = None) -> DataFrame:
    """One row: the six cells, ``decision`` and ``stratum_note``."""
    return one_row(cells).withColumns(
        {"decision": decision(settings or EvalSettings()), "stratum_note": stratum_flag()}
    )


RATIONALE = {
    "INSUFFICIENT_DATA": "no local probe could be made; ingest more documents",
    "TUNE_RETRIEVAL_FIRST": "single-source retrieval is weak (local recall@{k} {loc}); fix chunking or vectors first",
    "HYBRID_SUFFICIENT": "hybrid search already gathers the evidence (local {loc}, global {glo} at k={k})",
    "CONSIDER_GRAPH_OR_ROUTING": "single chunks are found (local {loc}) but spread evidence is missed (global {glo})",
    "MONITOR": "global recall@{k} {glo} is below target but close to local {loc}; add questions before deciding",
}


def write_report(
    run: EvalRun, index: CorpusIndex, doc_sources: DataFrame, folder: str,
    settings: EvalSettings | None = None,
) -> dict[str, Any]:
    """Write ``eval.json`` and ``eval.md``. Everything collected here is a few rows."""
    settings = settings or EvalSettings()
    cells = [r.asDict() for r in run.cells.orderBy("scope", "doc_class").collect()]
    row = decide(run.cells, settings).first().asDict()
    counts = doc_sources.agg(
        F.count_if(F.col("doc_class") == "native").alias("native"),
        F.count_if(F.col("doc_class") == "scan").alias("scan"),
    ).first()
    loc, glo = row["local_all_recall"], row["global_all_recall"]
    result = {
        "k": run.k,
        "route": run.route,
        "n_chunks": index.stats["n_chunks"],
        "n_probes": run.per_probe.count(),
        "n_docs_native": counts["native"],
        "n_docs_scan": counts["scan"],
        "cells": cells,
        "thresholds": {
            "local_recall_ok": settings.local_recall_ok,
            "global_recall_ok": settings.global_recall_ok,
            "gap": settings.gap,
        },
        "decision": row["decision"],
        "rationale": RATIONALE[row["decision"]].format(k=run.k, loc=loc, glo=glo),
        "stratum_note": bool(row["stratum_note"]),
        "per_probe": [r.asDict() for r in run.per_probe.orderBy("id").collect()],
    }
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    (out / "eval.json").write_text(json.dumps(result, indent=2), encoding="utf-8")
    table = "\n".join(
        f"| {c['scope']} | {c['doc_class']} | {c['n']} | {c['recall_at_k']} | {c['hit_rate']} | {c['mrr']} |"
        for c in cells
    )
    (out / "eval.md").write_text(
        "# Retrieval evaluation\n\n"
        f"- chunks: {result['n_chunks']}, probes: {result['n_probes']}, k: {run.k}\n"
        f"- documents: native {counts['native']}, scan {counts['scan']}\n\n"
        "| scope | class | n | recall@k | hit rate | MRR |\n|---|---|---|---|---|---|\n"
        f"{table}\n\n## Decision: {row['decision']}\n\n{result['rationale']}\n"
        + ("\nScanned sources trail native ones: improve ingestion first.\n" if result["stratum_note"] else ""),
        encoding="utf-8",
    )
    return result
