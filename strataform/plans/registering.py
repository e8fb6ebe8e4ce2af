"""How the query modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> tuple[dict[str, tuple[Query, str | None]], Callable]:
    """A map of queries, and a decorator that adds one by its function's name, with its SQL."""
    queries: dict[str, tuple[Query, str | None]] = {}

    def query(sql: str | None = None):
        def add(f: Query) -> Query:
            queries[f.__name__] = (f, sql)
            return f

        return add

    return queries, query
