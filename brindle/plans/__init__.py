"""All queries of the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from . import basic, siblings, tpch

MODULES = (tpch, basic, siblings)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
