"""Spark-native corpus retrieval and evaluation."""

from .plans.search import QueryBatch, hybrid_search, search_hits

__all__ = ["QueryBatch", "hybrid_search", "search_hits"]
