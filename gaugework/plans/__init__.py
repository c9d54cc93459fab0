"""Registered queries: each names the tables an operator runs on and, where SQL can say it, the check."""

from __future__ import annotations

import importlib

MODULES = [
    "relational", "graph", "statistics", "learning", "trees", "metrics", "runs", "pricing", "text", "sources", "generators",
]


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"gaugework.plans.{module}")
