"""Where queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the views under a name, with its SQL if SQL can express it."""

    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, path: build(Views(spark, path))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """A float rounded to 6 places under a name."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name or str(column))


def settled(x: Column) -> Column:
    """A solution of equations rounded to 6 places. Its error is below 11 places, which are rounded first: else it would put exact ties on either side."""
    return F.round(F.round(x, 11), 6)
