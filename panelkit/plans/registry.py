"""All registered queries, by name, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with SQL that gives the same rows where SQL can."""

    def keep(fn: Query) -> Query:
        if fn.__name__ in _QUERIES:
            raise ValueError(f"{fn.__name__} is registered twice")
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return keep


def oracle_sql_of(name: str) -> str:
    """The check SQL of a query that is registered already, for another form of it."""
    return _SQL[name]


def _load() -> None:
    from . import instances_core, instances_forecast, instances_more, instances_ranking, instances_staging, instances_stores  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
