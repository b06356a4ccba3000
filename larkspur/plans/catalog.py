"""All queries by name, and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) under its own name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


for _module in ("relational", "changes", "calendar", "scalars", "documents", "streams", "serving", "listpages", "control", "pieces"):
    import_module(f"larkspur.plans.{_module}")
