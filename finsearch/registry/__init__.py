"""Named queries over the given tables, each with an equivalent SQL statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finsearch.registry.roles import Roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Roles`` under a name, with its SQL statement."""

    def register(function: Callable[[Roles], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Roles(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load_all() -> None:
    from finsearch.registry import fraud, lakehouse, search, streams, tables  # noqa: F401
