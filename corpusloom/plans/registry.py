"""All queries of the corpus operators, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its reference SQL if SQL can express it."""

    def put(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _load() -> None:
    from importlib import import_module

    for name in ("term_queries", "text_queries", "domain_queries", "search_queries", "graph_queries", "page_queries"):
        import_module(f"corpusloom.plans.{name}")


_load()
