"""Where queries and their oracle SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(name: str, operators: str, sql: str | None = None) -> Callable:
    """Register a function of the views as a query; `operators` are the inventory ids it covers."""

    def wrap(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        OPERATORS[name] = operators
        if sql is not None:
            ORACLE[name] = sql
        return make

    return wrap
