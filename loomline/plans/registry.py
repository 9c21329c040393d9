"""Where queries and their SQL are kept, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Fixture:
    """Rows derived from a table by expressions that both engines read; the queries' input, not what they test."""

    def __init__(self, name: str, source: str, columns: dict[str, str], where: str = "TRUE") -> None:
        self.name, self.source, self.columns, self.where = name, source, columns, where
        self.sql = f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {where})"

    def __call__(self, spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, self.source).where(self.where).selectExpr(*(f"{e} AS {c}" for c, e in self.columns.items()))
