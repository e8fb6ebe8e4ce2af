"""Tables from schema files and delimited text, and graph folders of such files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import parse


def read_schema(spark: SparkSession, path: str, delimiter: str = ",") -> list[tuple[str, str]]:
    """(name, type name) for each line of a schema file; a line needs just two parts."""
    out = []
    for row in spark.read.text(path).collect():  # one line for each field
        if not row.value.strip():
            continue
        parts = [p.strip() for p in row.value.split(delimiter)]
        if len(parts) != 2:
            raise ValueError(f"not a name and a type: {row.value!r}")
        out.append((parts[0], parts[1]))
    return out


def read_csv(spark: SparkSession, path: str, fields: list[tuple[str, str]], delimiter: str = ",", header: bool = True) -> DataFrame:
    """A typed table from delimited text. List fields are quoted, as in "[1,2]"; a field
    that does not parse is null."""
    raw = T.StructType([T.StructField(n, T.StringType()) for n, _ in fields])
    rows = spark.read.schema(raw).option("sep", delimiter).option("header", header).option("quote", '"').option("enforceSchema", True).csv(path)
    return rows.select(*[parse(F.col(f"`{n}`"), kind).alias(n) for n, kind in fields])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text): the lines of a file, or of a folder's files in the order of their
    names, with their places from 0. Files are read in splits; lines are ordered by file,
    split and place in the split, and numbered from the partitions' counts."""
    from ..operators.tables import numbered

    rows = spark.read.text(path).select(F.col("value").alias("text"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
    return numbered(rows, "line", 0, ["file_path", "file_block_start", "place"]).select("line", "text")


def read_graph_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, label, year, features) and edges (src, dst) of a folder with
    node-label.csv, node_year.csv, node-feat.csv (a line for each vertex) and edge.csv."""
    label, year, feat = (numbered_lines(spark, f"{folder}/{n}.csv") for n in ("node-label", "node_year", "node-feat"))
    vertices = (
        label.select(F.col("line").alias("vid"), F.trim("text").cast("int").alias("label"))
        .join(year.select(F.col("line").alias("vid"), F.trim("text").cast("int").alias("year")), "vid")
        .join(feat.select(F.col("line").alias("vid"), F.split("text", ",").cast("array<double>").alias("features")), "vid")
    )
    edges = spark.read.schema("src long, dst long").csv(f"{folder}/edge.csv")
    return vertices, edges


def predicted_graph(vertices: DataFrame, predictions: DataFrame) -> DataFrame:
    """(vid, label, pred) of the vertices that have a prediction."""
    return vertices.select("vid", "label").join(predictions.select("vid", "pred"), "vid")


def columns_to_rows(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """Rows from columns of equal length: the first column's length holds; shorter
    columns end in nulls, longer ones are cut."""
    names = list(columns)
    size = len(columns[names[0]]) if names else 0
    return spark.createDataFrame([tuple(columns[n][k] if k < len(columns[n]) else None for n in names) for k in range(size)], names)
