"""How a module of queries registers them."""

from __future__ import annotations

from collections.abc import Callable


def register() -> tuple[dict, Callable]:
    """(name -> (query, its SQL twin or None), decorator that adds the function below it)."""
    queries: dict = {}

    def query(sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            queries[f.__name__] = (f, sql)
            return f

        return keep

    return queries, query
