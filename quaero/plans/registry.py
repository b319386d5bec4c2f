"""All registered queries of the note operators."""

from __future__ import annotations

from . import activity_queries, edit_queries, recall_queries, text_queries, view_queries

_MODULES = (activity_queries, text_queries, recall_queries, edit_queries, view_queries)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
