"""Archive and recovery of tables and graphs: Parquet folders with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def archive(tables: dict[str, DataFrame], path: str, kinds: dict[str, dict] | None = None) -> None:
    """Write each table under path, then the manifest that makes the archive valid."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    rows = [(name, df.schema.json(), json.dumps((kinds or {}).get(name, {}))) for name, df in tables.items()]
    spark.createDataFrame(rows, "name string, schema string, kind string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def recover(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, dict]]:
    """The tables of an archive with the schemas they were written with, and their kinds."""
    from pyspark.sql.types import StructType

    tables, kinds = {}, {}
    for row in spark.read.schema("name string, schema string, kind string").json(f"{path}/manifest").collect():
        tables[row.name] = spark.read.schema(StructType.fromJson(json.loads(row.schema))).parquet(f"{path}/tables/{row.name}")
        kinds[row.name] = json.loads(row.kind)
    return tables, kinds
