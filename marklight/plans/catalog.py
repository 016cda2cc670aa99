"""All core queries and their SQL."""

from __future__ import annotations

from marklight.plans import logs, runs, similarity, streams

MODULES = [logs, runs, similarity, streams]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
