"""Every operator's query and, where SQL can express it, the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
_replanned: set[str] = set()


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the operator's name."""

    def put(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if oracle is not None:
            _oracles[name] = oracle
        return f

    return put


def replanned(name: str) -> Callable[[Query], Query]:
    """Give a registered operator a plan of its own; its statement stays as the oracle that the plan must equal."""

    def put(f: Query) -> Query:
        if name not in _queries or name in _replanned:
            raise ValueError(f"{name} is not registered, or has a plan of its own already")
        _queries[name] = f
        _replanned.add(name)
        return f

    return put


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _oracles


def _load() -> None:
    from tidemark.operators import catalog  # noqa: F401  registers on import
