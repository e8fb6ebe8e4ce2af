"""Data preparation and propagation of graph networks: weighted adjacency times features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .tables import numbered
from .traverse import sampled_neighbours


def training_edges(vertices: DataFrame, edges: DataFrame, sample: int = -1, seed: int = 0) -> DataFrame:
    """(src, dst, weight) over dense ids in key order: distinct edges, up to sample for each
    source, and a loop at every vertex; weight is 1 / sqrt(out degree of src x in degree of dst)."""
    ids = checkpointed(numbered(vertices.select("vid").distinct(), "id", 0, ["vid"]))
    own = sampled_neighbours(edges, vertices, sample, seed) if sample >= 0 else edges.select("src", "dst")
    mapped = own.join(ids.toDF("a", "src"), "src").join(ids.toDF("b", "dst"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    full = mapped.unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
    out = full.groupBy("src").agg(F.count("*").alias("o"))
    into = full.groupBy("dst").agg(F.count("*").alias("i"))
    return full.join(out, "src").join(into, "dst").select("src", "dst", (1 / F.sqrt(F.col("o") * F.col("i"))).alias("weight"))


def propagated(weights: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """(id, features): for each dst the weighted sum of its sources' feature arrays. Summed
    by dimension, partly in the map tasks, whatever the width; only the sums are gathered."""
    joined = weights.join(features, weights["src"] == features["id"])
    each = joined.select("dst", "weight", F.posexplode(F.slice("features", 1, width)).alias("k", "x"))
    sums = each.groupBy("dst", "k").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    lists = sums.groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("by_k"))
    return lists.select(F.col("dst").alias("id"), F.transform("by_k", lambda e: e["x"]).alias("features"))


def appnp(weights: DataFrame, features: DataFrame, width: int, rounds: int, alpha: float = 0.5) -> DataFrame:
    """z <- (1 - alpha) A z + alpha h, from z = h."""
    z = features
    for _ in range(rounds):
        moved = propagated(weights, z, width).withColumnRenamed("features", "moved")
        blend = F.when(F.col("moved").isNull(), F.transform("features", lambda h: alpha * h)).otherwise(F.zip_with("moved", "features", lambda m, h: (1 - alpha) * m + alpha * h))
        z = checkpointed(features.join(moved, "id", "left").select("id", blend.alias("features")))
    return z


def edge_softmax(edges: DataFrame, score: str, slope: float = 0.02) -> DataFrame:
    """edges with attention: leaky-relu scores, normalised over each dst's edges."""
    leaky = edges.withColumn("_s", F.when(F.col(score) > 0, F.col(score)).otherwise(slope * F.col(score)))
    top = leaky.groupBy("dst").agg(F.max("_s").alias("_m"))
    raised = leaky.join(top, "dst").withColumn("_e", F.exp(F.col("_s") - F.col("_m")))
    total = raised.groupBy("dst").agg(F.sum("_e").alias("_t"))
    return raised.join(total, "dst").select(*edges.columns, (F.col("_e") / F.col("_t")).alias("attention"))


def gat_scores(edges: DataFrame, features: DataFrame, source: list[float], target: list[float]) -> DataFrame:
    """(src, dst, score) with score = source . features of src + target . features of dst."""
    dot = lambda weights: F.aggregate(F.zip_with("features", F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    a = features.select(F.col("id").alias("src"), dot(source).alias("_a"))
    b = features.select(F.col("id").alias("dst"), dot(target).alias("_b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("_a") + F.col("_b")).alias("score"))
