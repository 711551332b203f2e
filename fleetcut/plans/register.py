"""The table of queries that modules of this package add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetcut.plans.fixtures import Fleet, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Fleet], DataFrame]], Callable[[Fleet], DataFrame]]:
    """Register a function of the fleet under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Fleet], DataFrame]) -> Callable[[Fleet], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fleet(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add
