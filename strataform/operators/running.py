"""Totals along an order that no single task has to see whole."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running(df: DataFrame, groups: list[str], order: list[Column | str], values: dict[str, Column], fold=F.sum, keep: list[str] | None = None, part: str | None = None) -> DataFrame:
    """df with, for each name in values, its column folded (F.sum or F.max) over the rows of
    the same group up to and with this one; rows whose group is null are a group of their
    own. The order must tell all rows of a group apart.

    Rows are range-partitioned by group and order; only each partition's results by group
    pass through a window of their own, so a group that holds most rows is still spread
    over tasks. The partitioned rows are checkpointed: both the rows and the partitions'
    results must come from the same partitioning. A partition has earlier rows of its first
    group at most, so what is carried to it is one row, and the rows are not shuffled again.

    keep: the columns of df that are wanted, if not all. part: a name for the number of a
    row's partition, for folds that go on along the same order (see later_max)."""
    ranks = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = df.repartitionByRange(*[F.col(g) for g in groups], *ranks).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", *groups).orderBy(*ranks).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = df.columns if keep is None else keep
    parts = parts.withColumns({f"_in_{n}": fold(v).over(inside) for n, v in values.items()})
    parts = checkpointed(parts.select(*dict.fromkeys((*kept, *groups)), "_part", *[f"_in_{n}" for n in values]))
    totals = parts.groupBy("_part", *groups).agg(*[fold(v).alias(f"_all_{n}") for n, v in values.items()])
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *groups, *[fold(f"_all_{n}").over(ahead).alias(f"_ahead_{n}") for n in values])
    totals = totals.filter(reduce(or_, [F.col(f"_ahead_{n}").isNotNull() for n in values]))
    named = totals.withColumnsRenamed({c: f"_of_{c}" for c in ["_part", *groups]})
    same = [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups]  # nulls are a group, too
    joined = parts.join(F.broadcast(named), reduce(and_, same, F.col("_part") == F.col("_of__part")), "left")
    both = {n: F.greatest(f"_in_{n}", f"_ahead_{n}") if fold is F.max else F.col(f"_in_{n}") + F.coalesce(f"_ahead_{n}", F.lit(0)) for n in values}
    return joined.select(*kept, *([F.col("_part").alias(part)] if part else []), *[c.alias(n) for n, c in both.items()])


def running_totals(df: DataFrame, groups: list[str], order: list[Column | str], values: dict[str, Column], keep: list[str] | None = None, part: str | None = None) -> DataFrame:
    """Sums up to and with each row."""
    return running(df, groups, order, values, F.sum, keep, part)


def running_max(df: DataFrame, groups: list[str], order: list[Column | str], values: dict[str, Column]) -> DataFrame:
    """Largest values up to and with each row."""
    return running(df, groups, order, values, F.max)


def later_max(df: DataFrame, groups: list[str], part: str, back: Column, value: str, name: str) -> DataFrame:
    """df with the largest value of this and all later rows of its group. part: running's
    column, by which the rows are told apart once more; back: their order in it, backwards.
    Only a partition's last group has rows in later ones, so one row is carried to it."""
    inside = Window.partitionBy(part, *groups).orderBy(back).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = df.groupBy(part, *groups).agg(F.max(value).alias("_top"))
    ahead = Window.partitionBy(*groups).orderBy(F.desc(part)).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(c).alias(f"_of_{c}") for c in (part, *groups)], F.max("_top").over(ahead).alias("_later")).filter("_later is not null")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in groups]
    joined = df.withColumn("_best", F.max(value).over(inside)).join(F.broadcast(tops), reduce(and_, same, F.col(part) == F.col(f"_of_{part}")), "left")
    return joined.select(*df.columns, F.greatest("_best", "_later").alias(name))
