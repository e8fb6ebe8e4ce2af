"""Synthetic graphs with Zipf-distributed sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def zipf_edges(spark: SparkSession, vertices: int = 100, edges: int = 1000, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """(src, dst): sources drawn with weight 1 / rank ** alpha, destinations evenly.

    The inverse of the weights' integral gives the rank, so no table of weights is kept."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(2**53)) / 2**53
    power = 1 - alpha
    top = np.log(vertices + 1) if abs(power) < 1e-9 else ((vertices + 1) ** power - 1) / power
    rank = F.exp(u(1) * float(top)) if abs(power) < 1e-9 else F.pow(u(1) * float(top * power) + 1, F.lit(1 / power))
    src = F.least(F.greatest(F.floor(rank) - 1, F.lit(0)), F.lit(vertices - 1))
    return spark.range(edges).select(src.cast("long").alias("src"), F.floor(u(2) * vertices).cast("long").alias("dst"))
