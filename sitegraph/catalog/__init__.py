"""Named queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
_MODULES = ("sources", "nodes", "tree", "edits", "links", "frontier", "history", "mining", "reports", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows on the same tables."""

    def register(run: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query registered twice: {name}")
        _queries[name] = run
        if sql is not None:
            _oracles[name] = sql
        return run

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"sitegraph.catalog.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
