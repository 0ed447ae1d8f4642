"""Registered queries over the driver tables, each next to its check SQL."""

from __future__ import annotations

from importlib import import_module

from tidebar.catalog.base import QUERIES, Query

MODULES = ["q_windows", "q_sources", "q_tables", "q_functions", "q_quality", "q_research", "q_features", "q_books", "q_text", "q_landing"]


def load() -> dict[str, Query]:
    for m in MODULES:
        import_module(f"tidebar.catalog.{m}")
    return QUERIES
