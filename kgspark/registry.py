"""Registry of the library's queries: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: The module that registered each query.
_WHERE: dict[str, str] = {}


def register(name: str, oracle: str | None = None, where: str = "") -> Callable[[Query], Query]:
    """Decorator that registers a query and, where SQL can express it, its SQL."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        _WHERE[name] = where
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return add


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLES)


def load() -> None:
    """Imports the modules that register queries."""
    from kgspark.plans import all_modules

    all_modules()
