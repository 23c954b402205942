"""All registered queries with their SQL statements, grouped by area."""

from __future__ import annotations

from importlib import import_module

AREAS = (
    "lexical_queries", "scalar_queries", "inventory_queries", "index_queries", "navigation_queries", "check_queries",
    "source_queries",
)


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        for name, value in getattr(import_module(f"catalog.{area}"), attribute).items():
            if name in merged:
                raise ValueError(f"{name} is registered twice")
            merged[name] = value
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def statements() -> dict:
    return _merged("SQL")
