"""The registered queries of the core and, where SQL can express them, their SQL."""

from __future__ import annotations

from lexmill.plans import catalogue, dealt, documents, incremental, reading, upkeep

_MODULES = (catalogue, dealt, documents, incremental, reading, upkeep)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in getattr(m, "SQL", {}).items()}
