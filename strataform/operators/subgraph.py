"""Induced subgraphs, relabelled from 0, and what they hold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .tables import numbered


@dataclass(frozen=True)
class SubGraph:
    """nodes (new_id, vid), edges (src, dst) in new ids."""

    nodes: DataFrame
    edges: DataFrame

    def properties(self, vertices: DataFrame, key: str, fields: list[str]) -> DataFrame:
        """The nodes' property rows, by new id."""
        return self.nodes.join(vertices, self.nodes["vid"] == vertices[key]).select("new_id", *[vertices[f] for f in fields])


    def flattened(self, vertices: DataFrame, key: str, field: str) -> DataFrame:
        """(new_id, pos, value): a property's values in the nodes' order, an element for each
        row where it is a list (pos from 0), so that no row grows with the graph."""
        rows = self.properties(vertices, key, [field])
        if isinstance(rows.schema[field].dataType, T.ArrayType):
            return rows.select("new_id", F.posexplode(field).alias("pos", "value"))
        return rows.select("new_id", F.lit(0).alias("pos"), F.col(field).alias("value"))

    def vector_size(self, vertices: DataFrame, key: str, field: str) -> DataFrame:
        """(size): the length of the first node's list."""
        return self.properties(vertices, key, [field]).agg(F.min_by(F.size(field), "new_id").alias("size"))


def induced(edges: DataFrame, seeds: DataFrame) -> SubGraph:
    """Edges with both ends among seeds (vid), repeats kept; nodes without such an edge
    are left out; new ids follow the keys."""
    s = checkpointed(seeds.select("vid").distinct())
    few = F.broadcast if s.count() <= 1_000_000 else lambda rows: rows
    inside = edges.join(few(s.withColumnRenamed("vid", "src")), "src", "left_semi").join(few(s.withColumnRenamed("vid", "dst")), "dst", "left_semi").select("src", "dst")
    ends = inside.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    nodes = numbered(ends, "new_id", 0, ["vid"])
    a, b = nodes.toDF("a", "src"), nodes.toDF("b", "dst")
    return SubGraph(nodes, inside.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def induced_by_type(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For edges (src_type, src, dst_type, dst) and seeds (vpid, key): nodes (vpid, key,
    new_id), numbered within each type, and edges (edge_type, src, dst) in new ids, where
    edge_type is the source type in the upper and the destination type in the lower bits."""
    from .running import running_totals

    s = seeds.select("vpid", "key").distinct()
    inside = edges.join(s.toDF("src_type", "src"), ["src_type", "src"], "left_semi").join(s.toDF("dst_type", "dst"), ["dst_type", "dst"], "left_semi")
    ends = inside.select(F.explode(F.array(F.struct(F.col("src_type").alias("vpid"), F.col("src").alias("key")), F.struct(F.col("dst_type").alias("vpid"), F.col("dst").alias("key")))).alias("e")).select("e.*").distinct()
    nodes = running_totals(ends, ["vpid"], ["key"], {"new_id": F.lit(1).cast("long")}).withColumn("new_id", F.col("new_id") - 1)
    a, b = nodes.toDF("src_type", "src", "a"), nodes.toDF("dst_type", "dst", "b")
    kind = F.shiftleft(F.col("src_type").cast("long"), 32) + F.col("dst_type")
    return nodes, inside.join(a, ["src_type", "src"]).join(b, ["dst_type", "dst"]).select(kind.alias("edge_type"), F.col("a").alias("src"), F.col("b").alias("dst"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("edges"))
