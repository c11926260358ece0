"""Command line: ``python -m quarrylight <command> ...``.

Commands take the session from ``spark-submit`` when there is one.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import recipe as R
from .evaluation.experiments import arm_means, verdict
from .evaluation.probes import global_probes
from .functions.text import slug_from_path
from .plans.arms import four_arm_results
from .plans.evaluation import run_eval, write_report
from .plans.experiment import run_experiments, score_external
from .plans.graph import build_graph
from .plans.index import build_index, open_index
from .plans.ingest import intermediate_documents, write_product
from .session import spill
from .sources.pages import html_blocks, parse_files
from .sources.products import (
    document_features, document_sources, require_rows, scan_chunks_strict, scan_gold, scan_meta,
)

USAGE = """usage: python -m quarrylight <command>
  ingest <files> [outputs]      parse documents and write product folders
  index [recipe]                build the index
  graph [recipe]                build the concept graph
  eval [recipe]                 probe the retriever, decide, write a report
  experiment [recipe]           by kind, difficulty, modifiers, factorial
  score <gold.json> [recipe] [--route] [--k K] [--sample N] [--seed S]
  bench [recipe]                four retrieval arms on global probes"""


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("quarrylight").getOrCreate()


def _recipe(args: list[str], at: int = 0) -> R.Recipe:
    return R.open_recipe(args[at] if len(args) > at else R.DEFAULT_RECIPE)


def _index(spark: SparkSession, recipe: R.Recipe):
    return open_index(spark, recipe.resolve(recipe.index.index_path), recipe.index.model)


def ingest(args: list[str]) -> int:
    if not args:
        print("usage: python -m quarrylight ingest <files> [outputs]")
        return 2
    spark, outputs = _spark(), args[1] if len(args) > 1 else "outputs"
    if args[0].lower().endswith((".html", ".htm", ".xml")):
        files = spark.read.text(args[0], wholetext=True).withColumn("_file", F.col("_metadata.file_path"))
        blocks = html_blocks(files, slug_from_path(F.col("_file")), "value")
    else:
        blocks = parse_files(spark, args[0])
    for row in write_product(intermediate_documents(blocks), outputs).toLocalIterator():
        print(f"ingested {row['doc_id']} -> {row['path']} ({row['n_chunks']} chunks, {row['status']})")
    return 0


def index(args: list[str]) -> int:
    spark, recipe = _spark(), _recipe(args)
    outputs = recipe.resolve(recipe.index.outputs_dir)
    chunks = require_rows(scan_chunks_strict(spark, outputs), outputs)
    built = build_index(chunks, recipe.resolve(recipe.index.index_path), recipe.index.model)
    print(f"indexed {built.stats['n_chunks']} chunks from {built.stats['n_docs']} documents at {built.path}")
    return 0


def graph(args: list[str]) -> int:
    spark, recipe = _spark(), _recipe(args)
    built = build_graph(_index(spark, recipe).chunks, recipe.resolve(recipe.graph.path), recipe.graph)
    m = built.meta
    print(f"concepts {m['n_concepts_raw']} -> {m['n_concepts_kept']}, edges {m['n_edges']}, "
          f"communities {m['n_communities']} (largest {m['largest_community']}) at {built.path}")
    return 0


def evaluate(args: list[str]) -> int:
    spark, recipe = _spark(), _recipe(args)
    ix = _index(spark, recipe)
    sources = document_sources(scan_meta(spark, recipe.resolve(recipe.index.outputs_dir)))
    run = run_eval(ix, sources, recipe.evaluation, recipe.search)
    folder = recipe.resolve("eval")
    out = write_report(run, ix, sources, folder, recipe.evaluation)
    print(f"probes={out['n_probes']} k={out['k']}\nDECISION: {out['decision']}\n{out['rationale']}")
    for cell in out["cells"]:
        print(f"recall of {cell['scope']} probes, {cell['doc_class']} documents: {cell['recall_at_k']} ({cell['n']})")
    print(f"report in {folder}")
    return 0


def experiment(args: list[str]) -> int:
    spark, recipe = _spark(), _recipe(args)
    features = document_features(scan_meta(spark, recipe.resolve(recipe.index.outputs_dir)))
    results = run_experiments(_index(spark, recipe), features, recipe.evaluation)
    for name, frame in results.items():
        print(f"== {name} ==")
        print("\t".join(frame.columns))
        for row in frame.orderBy(*frame.columns[:2]).toLocalIterator():
            print("\t".join(str(v) for v in row))
    cells = {r["cell"]: r["recall_at_b"] for r in results["factorial"].collect()}
    for cell, value in cells.items():
        if value is not None and cells.get("single") is not None:
            print(f"{cell}: {value - cells['single']:+.3f} against single")
    return 0


def _score_arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m quarrylight score", description="Score the index on gold from outside.")
    parser.add_argument("gold", help="file of gold questions")
    parser.add_argument("recipe", nargs="?", default=R.DEFAULT_RECIPE)
    parser.add_argument("--route", action="store_true", help="let the router choose each query's width")
    parser.add_argument("--k", dest="top_k", type=int, help="hits asked for per question")
    parser.add_argument("--sample", type=int, help="questions to draw")
    parser.add_argument("--seed", type=int, help="seed of the draw")
    return parser


def score(args: list[str]) -> int:
    try:
        asked = vars(_score_arguments().parse_args(args))
    except SystemExit as stop:
        return 0 if stop.code in (0, None) else 2
    gold, recipe = asked.pop("gold"), asked.pop("recipe")
    options = {name: value for name, value in asked.items() if value not in (None, False)}
    spark, settings = _spark(), R.open_recipe(recipe)
    table = score_external(_index(spark, settings), scan_gold(spark, gold), settings.search, **options)
    print("scope\tquestions\trecall\thit rate")
    for row in table.orderBy("scope").collect():
        print("\t".join(str(row[c]) for c in ("scope", "n", "recall", "hit_rate")))
    return 0


def bench(args: list[str]) -> int:
    spark, recipe = _spark(), _recipe(args)
    ix = _index(spark, recipe)
    built = build_graph(ix.chunks, recipe.resolve(recipe.graph.path), recipe.graph)
    n = recipe.evaluation.n_local
    probes = spill(global_probes(ix, n, 20), "probes")
    arms = four_arm_results(ix, built, probes, n, 20, recipe.search, recipe.graph)
    table = spill(arm_means(probes, arms), "means")
    means = {r["arm"]: r["mean_recall"] or 0.0 for r in table.collect()}
    word = verdict(table).first()["verdict"]
    print(f"{means}\n{word}")
    print("BENCH_JSON " + json.dumps({"n_probes": probes.count(), "k": 20, "mean_recall": means, "verdict": word}))
    return 0


COMMANDS = {
    "ingest": ingest, "index": index, "graph": graph, "eval": evaluate, "experiment": experiment,
    "score": score, "bench": bench,
}


def main(argv: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if not args or args[0] not in COMMANDS:
        print(USAGE)
        return 2
    return COMMANDS[args[0]](args[1:])
