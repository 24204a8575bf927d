"""The registry of the engine's own queries and the SQL that each is compared with."""

from __future__ import annotations

import importlib

MODULES = ("permutation", "inventory", "layout", "checks", "digests", "inference", "formats")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tensorloom.queries.{name}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
