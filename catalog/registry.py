"""All registered queries and comparison SQL."""

from __future__ import annotations

from . import evaluate, files, graph, ingest, lookups, search

MODULES = [search, evaluate, graph, ingest, lookups, files]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
