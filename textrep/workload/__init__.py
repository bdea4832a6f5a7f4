"""Queries over the given tables, each next to the SQL it must agree with."""

from __future__ import annotations

from importlib import import_module

MODULES = ("corpus", "scores", "encoders", "models", "reports")


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"textrep.workload.{name}"), attribute)
        repeated = found.keys() & part.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        found.update(part)
    return found


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
