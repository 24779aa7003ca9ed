"""The registered queries: operators bound to the given tables, with their SQL checks."""

from __future__ import annotations

import importlib

MODULES = ("graph_model", "concrete", "abstract", "ontology", "governance", "networks")


def load_queries():
    """Import the plan modules and return the filled registry."""
    from kgspark.plans.registry import QUERIES
    for module in MODULES:
        importlib.import_module(f"kgspark.plans.{module}")
    return QUERIES
