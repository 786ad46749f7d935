"""Registry of named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .standins import Views, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL it is checked by tests instead."""

    def add(function: Callable[[Views], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_views(sql)
        return function

    return add


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: QUERIES[name](Views(spark, sf_dir))


def r9(*columns: str) -> list[Column]:
    """Columns rounded to 9 digits, where sums in different order still agree."""
    return [F.round(c, 9).alias(c) for c in columns]


def r9_sql(*columns: str) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns)
