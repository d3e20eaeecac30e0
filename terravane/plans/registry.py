"""The catalogue: a plan is a named query over a data folder, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The tables of a data folder, read when named: t.orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def plan(name: str, sql: str | None = None):
    """Register a function of Tables under a name."""

    def register(make: Callable[[Tables], DataFrame]):
        if name in _PLANS:
            raise ValueError(f"two plans named {name}")
        _PLANS[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            _SQL[name] = sql
        return make

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
