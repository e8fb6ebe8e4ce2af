"""Profiles of versions, graphs and predictions; comparison and metadata tables."""

from __future__ import annotations

import resource
import time
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def label_profile(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy("label")


def version_profile(items: DataFrame, annotations: DataFrame, key: str, kind: str) -> DataFrame:
    """images, without annotations, and annotations of the kind object, in one row."""
    marked = items.select(key).join(annotations.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(F.col(kind) == "object").alias("_o")), key, "left")
    return marked.agg(
        F.count("*").alias("images"), F.count_if(F.col("_n").isNull()).alias("without"), F.coalesce(F.sum("_o"), F.lit(0)).alias("objects"),
        (F.coalesce(F.sum("_n"), F.lit(0)) / F.count("*")).alias("per_image"),
    )


def predict_profile(images: DataFrame, predictions: DataFrame, key: str, kind: str, fps: str) -> DataFrame:
    """images, without predictions, predicted objects, objects per image and mean fps, in one row."""
    marked = images.select(key, fps).join(predictions.groupBy(key).agg(F.count_if(F.col(kind) == "object").alias("_o")), key, "left")
    objects = F.coalesce(F.sum("_o"), F.lit(0))
    return marked.agg(F.count("*").alias("images"), F.count_if(F.col("_o").isNull()).alias("without"), objects.alias("objects"), (objects / F.count("*")).alias("per_image"), F.coalesce(F.avg(fps), F.lit(0.0)).alias("fps"))


def label_counts(categories: DataFrame, predictions: DataFrame, label: str) -> DataFrame:
    """(label, n) of all categories, those without predictions included, by label."""
    counts = predictions.groupBy(label).agg(F.count("*").alias("n"))
    return categories.select(label).distinct().join(counts, label, "left").select(F.col(label).alias("label"), F.coalesce("n", F.lit(0)).alias("n")).orderBy("label")


def graph_profile(vertices: DataFrame, edges: DataFrame, label: str, year: str) -> DataFrame:
    """nodes, edges, classes, sorted labels and years; the two counts are one row each."""
    v = vertices.agg(F.count("*").alias("nodes"), F.count_distinct(label).alias("classes"), F.sort_array(F.collect_set(label)).alias("labels"), F.sort_array(F.collect_set(year)).alias("years"))
    e = edges.agg(F.count("*").alias("edges"))
    return v.withColumn("_", F.lit(1)).join(e.withColumn("_", F.lit(1)), "_").drop("_")


def comparison(parts: list[DataFrame]) -> DataFrame:
    """Profile rows one below the other; fields that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def described(metadata: DataFrame, nodes: DataFrame, key: str = "metadata_id") -> DataFrame:
    return metadata.join(nodes, key)


def log_fields(logs: DataFrame, fields: list[str], condition: Column | None = None) -> DataFrame:
    """The named fields of training logs."""
    rows = logs.filter(condition) if condition is not None else logs
    return rows.select(*fields)


def task_profile(tasks: DataFrame, lc_id) -> DataFrame:
    return tasks.filter(F.col("lc_id") == F.lit(lc_id)).select("task_name", F.col("time_start").alias("started"), F.col("duration").alias("seconds"))


TASKS = "lc_id string, task_name string, time_start timestamp, duration double, mem_stat long, io_stat long, cpu_stat double"


class TaskProfiler:
    """Measures tasks of the driver: wall time, growth of its largest resident size in
    bytes, blocks read, CPU seconds. What a task's jobs take on executors is in Spark's own
    event log."""

    def __init__(self, spark: SparkSession, lc_id: str):
        self.spark, self.lc_id, self.rows = spark, lc_id, []

    @contextmanager
    def task(self, name: str):
        began, clock, before = datetime.now(), time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF)
        try:
            yield self
        finally:
            after = resource.getrusage(resource.RUSAGE_SELF)
            cpu = after.ru_utime + after.ru_stime - before.ru_utime - before.ru_stime
            self.rows.append((self.lc_id, name, began, time.perf_counter() - clock, 1024 * (after.ru_maxrss - before.ru_maxrss), after.ru_inblock - before.ru_inblock, cpu))

    def tasks(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, TASKS)
