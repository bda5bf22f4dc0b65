"""Queries and their SQL, found by looking through versoline.queries: a new module is a new set of queries."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _queries and _queries[key].__module__ != f.__module__:
            raise ValueError(f"two queries are named {key}")
        _queries[key] = f
        if oracle is not None:
            _oracles[key] = oracle
        return f

    return add


def load() -> None:
    from . import queries as package

    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{package.__name__}.{module.name}")
    if not _queries:
        raise ValueError("no queries found")


def queries() -> dict[str, Query]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_oracles)
