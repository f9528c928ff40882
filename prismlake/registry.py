"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = [
    "prismlake.operators.similarity", "prismlake.operators.vector_index", "prismlake.operators.grouping", "prismlake.operators.strategies", "prismlake.operators.ranking", "prismlake.operators.people", "prismlake.operators.matching",
    "prismlake.operators.batches", "prismlake.operators.frames", "prismlake.operators.sync", "prismlake.operators.report", "prismlake.functions.scalars", "prismlake.functions.requests", "prismlake.functions.containers", "prismlake.functions.cascade",
    "prismlake.sources.catalogue", "prismlake.sources.server", "prismlake.sources.paged", "prismlake.sources.library", "prismlake.sources.local", "prismlake.sources.sink", "prismlake.plans.actions", "prismlake.streaming.polling", "prismlake.streaming.reconcile",
]
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the session and the tables' folder, with the SQL that has the same result, if there is any."""

    def add(function):
        _queries[name] = function
        if sql:
            _sql[name] = sql
        return function

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(module)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _queries["best_of_groups"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
