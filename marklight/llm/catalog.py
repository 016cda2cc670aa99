"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from marklight.llm import groups, mixing, nearcopies, packing, pii, setjoin, spans, terms, truncation

MODULES = [groups, mixing, nearcopies, packing, pii, setjoin, spans, terms, truncation]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
