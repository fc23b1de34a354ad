"""Registered queries, each with the SQL it is checked against."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("search", "views", "relations", "catalog", "journal", "metadata", "library", "organizer", "reading")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").ORACLES.items()}


def flagship(spark, sf_dir: str):
    """Ranked phrase search."""
    return queries()["search_phrase"](spark, sf_dir)
