"""Every query of the library by name, and its DuckDB counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "p3_folded_search"

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Modules that register queries.
CATALOG = ("search", "text", "dates", "longitudes", "solar", "plans", "records", "nested", "ranges", "parts")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under a name, with the DuckDB SQL that gives the same rows."""

    def keep(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = function
        if sql is not None:
            _sql[name] = sql
        return function

    return keep


def _load() -> None:
    for module in CATALOG:
        importlib.import_module(f"skyledger.catalog.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
