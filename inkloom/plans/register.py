"""A module's queries and their SQL, gathered by a decorator."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator): the decorator takes the SQL, if there is any."""
    queries: dict = {}
    sql: dict = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
