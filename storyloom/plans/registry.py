"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "sc_daily_source_volume"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query and the SQL that gives the same rows."""

    def add(query: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = query
        if sql:
            _ORACLES[name] = sql
        return query

    return add


def _load() -> None:
    """Modules register their queries when they are first imported."""
    from storyloom.plans import articles, entities, explore, incremental, learning, names, rules, signals, state, stories  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
