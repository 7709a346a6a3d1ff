"""Registry of named queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inquest.plans.tables import Tables, oracle_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` under ``key``.

    ``sql`` is the body of the equivalent SQL statement; ``views`` names the
    adapter views it reads, which are put in front as common table expressions.
    A body that has its own WITH list starts with ``WITH`` or ``WITH RECURSIVE``.
    """

    def wrap(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = oracle_prefix(sql, views)
        return fn

    return wrap
