"""Operators for building training data; nothing else in the library imports them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("chat", "near_dedup", "sharding", "language", "byte_bpe", "token_counts", "exact_dedup", "topk", "lines", "mixing")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__name__}.{m}").ORACLES.items()}
