"""Registration of queries: each has a name that starts with its operator's number, and its SQL if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries that SQL can't say; tests hold them against brute force.
WITHOUT_SQL: dict[str, Query] = {}
FLAGSHIP = "r03_reference_verdicts"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        (QUERIES if sql else WITHOUT_SQL)[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from . import analytics, han, ingest, matching, policies, scalars, search, state, structuring, whole  # noqa: F401
