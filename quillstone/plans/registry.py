"""All queries over the library's tables, and their SQL for DuckDB.

A module of queries calls ``query`` on each; ``queries`` and ``oracle_sql`` gather what they registered.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources.tables import with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ["retrieval", "store", "biblio", "curation", "parsing", "articles", "files", "search", "phrases", "bitmaps"]


def query(name: str, sql: str | None = None, *views: str):
    """Registers a query under its name, with the SQL that must give the same rows (None where SQL can't say it)."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = with_views(sql, *views)
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"quillstone.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return queries()["hybrid_topk"](spark, d)
