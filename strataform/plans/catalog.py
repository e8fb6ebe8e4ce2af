"""The registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import file_queries, graph_queries, table_queries, version_queries

PARTS = (table_queries, file_queries, graph_queries, version_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated documents counted by label."""
    return version_queries.QUERIES["label_profile"][0](spark, sf_dir)
