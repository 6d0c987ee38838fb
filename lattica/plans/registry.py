"""Every reference-operator query with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "csg_union"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Add a query under a name, with the SQL that must give the same rows."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return add


def _load() -> None:
    from . import field_queries, index_queries, shape_queries, solid_queries  # noqa: F401  (they register themselves)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
