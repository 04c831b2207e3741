"""Corpus operators for training data, each in a module with its queries ``Q`` and the SQL ``S`` they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "quality_rules", "exact_dedup", "line_dedup", "mixing", "best_fit", "near_dedup", "suffix_dedup", "license_scan", "kd_sharding", "kn_classifier", "token_counts", "spelling_variants", "lexical_search",
)


def registry():
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"opsloom.llm.{name}")
        queries.update(module.Q)
        oracles.update(module.S)
    return queries, oracles
