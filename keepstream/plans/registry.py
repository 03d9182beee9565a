"""Queries and their SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def __call__(self, sql: str | None = None):
        def keep(f: Query) -> Query:
            self.add(f.__name__, f, sql)
            return f

        return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
