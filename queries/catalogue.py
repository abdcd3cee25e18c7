"""Collects the query modules."""

from __future__ import annotations

import importlib

from queries import registry

MODULES = ["sources", "profile", "clean", "combine", "groups", "split", "textfeat", "terms", "encode", "models", "evaluate", "stream", "flows"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"queries.{m}")


def queries():
    _load()
    return dict(sorted(registry.QUERIES.items()))


def oracle_sql():
    _load()
    return dict(sorted(registry.SQL.items()))
