"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from . import more_queries, search_queries, store_queries, text_queries

FLAGSHIP = "search_sections"
_MODULES = [text_queries, store_queries, search_queries, more_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
