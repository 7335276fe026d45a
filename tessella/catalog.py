"""The table of registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.fixtures import World, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of a World under its name, with its SQL over the named views."""

    def add(f: Callable[[World], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(World(spark, folder))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return add
