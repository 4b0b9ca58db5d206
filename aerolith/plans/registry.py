"""Where queries and their SQL are put by key of the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry() -> tuple[dict, dict[str, str], Callable]:
    """Queries, their SQL, and a decorator that adds to both."""
    queries: dict = {}
    texts: dict[str, str] = {}

    def query(key: str, sql: str):
        def put(f):
            queries[key], texts[key] = f, sql
            return f

        return put

    return queries, texts, query


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def d(value: float) -> str:
    """A double in SQL; plain decimals would be computed as such."""
    return f"CAST({value!r} AS DOUBLE)"
