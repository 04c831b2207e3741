"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("cleaning", "quality", "features", "profiling", "splitting", "search", "fusing", "modeling", "prepare")


def registry():
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"opsloom.plans.{name}")
        queries.update(module.Q)
        oracles.update(module.S)
    return queries, oracles
