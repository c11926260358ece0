"""The recipe: one YAML file that fixes corpus, index, retrieval, graph and evaluation."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

DEFAULT_RECIPE = "recipe.yaml"


def load(path: str | os.PathLike = DEFAULT_RECIPE, spark=None) -> dict[str, Any]:
    """The recipe's mapping; with a session also from any file system that Spark reads.

    A missing file raises, a file without content is an empty mapping, anything that is not
    a mapping is refused.
    """
    import yaml

    if spark is None:
        with open(path, encoding="utf-8") as recipe:
            content = recipe.read()
    else:
        content = "".join(r["value"] for r in spark.read.text(os.fspath(path), wholetext=True).collect())
    found = yaml.safe_load(content)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"a recipe is a mapping, not {type(found).__name__}: {path}")
    return found


def _block(recipe: dict[str, Any], *names: str) -> dict[str, Any]:
    node: Any = recipe
    for name in names:
        node = (node or {}).get(name) or {}
    return node


@dataclass(frozen=True)
class IndexSettings:
    index_path: str = "index"
    model: str = "hashed-384"
    outputs_dir: str = "outputs"


@dataclass(frozen=True)
class SearchSettings:
    rrf_k: int = 60
    top_k: int = 8
    rerank_enabled: bool = False
    rerank_model: str = "token-overlap"
    routing_enabled: bool = False
    routing_margin: float = 0.03
    global_candidate_k: int = 60
    global_top_k: int = 20


@dataclass(frozen=True)
class GraphSettings:
    enabled: bool = False
    path: str = "graph"
    embedder_model: str = "hashed-384"
    min_concept_freq: int = 2
    min_concept_chars: int = 3
    max_concept_tokens: int = 4
    max_concepts: int = 4000
    max_concepts_per_chunk: int = 40
    drop_generic: bool = True
    min_edge_weight: int = 2
    max_node_degree: int | None = None
    resolution: float = 1.0
    seed: int = 42
    seed_sim_min: float = 0.30
    seed_z: float = 2.0
    seed_top_n: int = 12
    seed_concepts: tuple[str, ...] = ()
    relevant_communities: int = 5
    community_prior_w: float = 0.5
    max_hops: int = 2
    hop_decay: float = 0.5
    budget_concepts: int = 200
    budget_chunks: int = 600
    fusion: str = "accum"
    rrf_k: int = 60
    alpha: float = 0.5
    multi_hit_w: float = 0.3
    fallback_hybrid: bool = False


@dataclass(frozen=True)
class EvalSettings:
    top_k: int = 10
    n_local: int = 30
    local_recall_ok: float = 0.6
    global_recall_ok: float = 0.7
    gap: float = 0.25


@dataclass(frozen=True)
class Recipe:
    index: IndexSettings = field(default_factory=IndexSettings)
    search: SearchSettings = field(default_factory=SearchSettings)
    graph: GraphSettings = field(default_factory=GraphSettings)
    evaluation: EvalSettings = field(default_factory=EvalSettings)
    base_dir: str = "."

    def resolve(self, path: str) -> str:
        """Paths in a recipe are relative to the recipe; URIs and absolute paths stay."""
        if "://" in path or os.path.isabs(path):
            return path
        return str(Path(self.base_dir) / path)


def resolve(recipe: dict[str, Any], base_dir: str = ".") -> Recipe:
    """Typed settings with defaults for every missing key."""
    index, embedder = _block(recipe, "index"), _block(recipe, "index", "embedder")
    retrieve = _block(recipe, "retrieve")
    rerank, routing = _block(recipe, "retrieve", "rerank"), _block(recipe, "retrieve", "routing")
    graph, graph_embedder = _block(recipe, "graph"), _block(recipe, "graph", "embedder")
    ev, limits = _block(recipe, "eval"), _block(recipe, "eval", "thresholds")

    def pick(block: dict[str, Any], cls: type, renames: dict[str, str] | None = None) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for name, f in cls.__dataclass_fields__.items():
            key = (renames or {}).get(name, name)
            if key not in block:
                continue
            kind, value = type(f.default), block[key]
            if name == "seed_concepts":
                out[name] = tuple(value or ())
            elif f.default is None:
                out[name] = None if value is None else int(value)
            else:
                out[name] = kind(value)
        return out

    model = embedder.get("model", IndexSettings.model)
    settings_index = IndexSettings(
        index_path=index.get("path", IndexSettings.index_path),
        model=model,
        outputs_dir=_block(recipe, "corpus").get("outputs_dir", IndexSettings.outputs_dir),
    )
    settings_search = SearchSettings(
        **pick(retrieve, SearchSettings),
        **pick(rerank, SearchSettings, {"rerank_enabled": "enabled", "rerank_model": "model"}),
        **{
            k: v
            for k, v in pick(
                routing, SearchSettings, {"routing_enabled": "enabled", "routing_margin": "margin"}
            ).items()
            if k.startswith(("routing_", "global_"))
        },
    )
    settings_graph = GraphSettings(
        **{
            **pick(graph, GraphSettings,
                   {"resolution": "leiden_resolution", "seed": "leiden_seed"}),
            "embedder_model": graph_embedder.get("model", model),
        }
    )
    settings_eval = EvalSettings(
        **{
            **({"top_k": int(retrieve["top_k"])} if "top_k" in retrieve else {}),
            **pick(ev, EvalSettings),
            **pick(limits, EvalSettings),
        }
    )
    return Recipe(settings_index, settings_search, settings_graph, settings_eval, base_dir)


def open_recipe(path: str | Path = DEFAULT_RECIPE) -> Recipe:
    return resolve(load(path), str(Path(path).resolve().parent))
