"""Registry of named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lacuna.plans.standin import Inputs, duck_views
from lacuna.session import tune

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query. `sql` continues the WITH clause of the stand-in views (', x AS (…) SELECT …' or 'SELECT …')."""

    def keep(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = f"{duck_views()}\n{sql.strip()}"
        return fn

    return keep


def bind(fn: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Inputs(tune(spark), folder.rstrip("/")))

    run.__name__ = fn.__name__
    return run
