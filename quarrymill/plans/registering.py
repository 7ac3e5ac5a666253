"""A query, and its SQL, under its function's name."""

from __future__ import annotations

from collections.abc import Callable


def registers(queries: dict, sqls: dict[str, str]):
    """A decorator maker that keeps a function, and the SQL given to it, in two dictionaries."""

    def query(sql: str | None = None):
        def keep(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return keep

    return query
