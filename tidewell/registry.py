"""Named operators: what runs in Spark, and the SQL text that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, Callable[[], str]] = {}


def query(name: str, oracle: Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under name, with the SQL to hold it against."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return put


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: text() for name, text in _ORACLES.items()}
