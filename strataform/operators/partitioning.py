"""How tables and graphs would be dealt to parts, and what the cut costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_part, range_part


def part_counts(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.groupBy(hash_part(F.col(key), parts).alias("part")).agg(F.count("*").alias("rows"))


def range_counts(df: DataFrame, key: str, splits: list) -> DataFrame:
    return df.groupBy(range_part(F.col(key), splits).alias("part")).agg(F.count("*").alias("rows"))


def edge_cut(edges: DataFrame, parts: int) -> DataFrame:
    """By the source's part: edges, and those whose destination lies in another part."""
    s, d = hash_part(F.col("src"), parts), hash_part(F.col("dst"), parts)
    return edges.groupBy(s.alias("part")).agg(F.count("*").alias("edges"), F.count_if(s != d).alias("cut"))


def vertex_cut(edges: DataFrame, parts: int, by: str = "src") -> DataFrame:
    """(part, vid, is_replica): edges are dealt by the key of one end; that end's vertices
    are owned there, the other ends are replicas where they are not owned."""
    other = "dst" if by == "src" else "src"
    rows = edges.select(hash_part(F.col(by), parts).alias("part"), F.col(by).alias("own"), F.col(other).alias("far"))
    owned = rows.select("part", F.col("own").alias("vid")).distinct()
    seen = rows.select("part", F.col("far").alias("vid")).distinct()
    copies = seen.join(owned, ["part", "vid"], "left_anti")
    return owned.withColumn("is_replica", F.lit(False)).unionByName(copies.withColumn("is_replica", F.lit(True)))


def vertex_cut_range(edges: DataFrame, splits: list[int], by: str = "src") -> DataFrame:
    """vertex_cut with ranges of the key instead of its remainder."""
    other = "dst" if by == "src" else "src"
    rows = edges.select(range_part(F.col(by), splits).alias("part"), F.col(by).alias("own"), F.col(other).alias("far"))
    owned = rows.select("part", F.col("own").alias("vid")).distinct()
    copies = rows.select("part", F.col("far").alias("vid")).distinct().join(owned, ["part", "vid"], "left_anti")
    return owned.withColumn("is_replica", F.lit(False)).unionByName(copies.withColumn("is_replica", F.lit(True)))


def edge_balanced_splits(edges: DataFrame, parts: int, by: str = "src", error: float = 0.001) -> list[float]:
    """Key splits that give each part about as many edges: quantiles of the edges' keys,
    of which the driver gets parts - 1 numbers."""
    return edges.approxQuantile(by, [k / parts for k in range(1, parts)], error)
