"""Deterministic probes, metrics and experiments."""
