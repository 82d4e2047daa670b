"""Where the operators' queries and their SQL are kept."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL for its result where SQL can state it."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function
    return register
