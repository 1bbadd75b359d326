"""Registry of queries over the given tables and their checks in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.canonical import Journal, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a function of a Journal; sql follows the CTEs of the named views (and may begin with its own)."""

    def register(build: Callable[[Journal], DataFrame]) -> Callable[[Journal], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Journal(spark, folder))
        if sql is not None:
            head = ctes(*views.split()) if views else ""
            own = sql.strip()
            if own.upper().startswith("WITH "):
                SQL[name] = f"WITH {head}{', ' if head else ''}{own[5:]}"
            else:
                SQL[name] = f"WITH {head} {own}" if head else own
        return build

    return register
