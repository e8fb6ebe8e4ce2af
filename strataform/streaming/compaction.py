"""Continuous ingest: edges and events arrive as a stream and are folded into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_edges(stream: DataFrame, main: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch to the Parquet table main, sorted by source, in a folder
    named by its batch number: a batch that is done again overwrites itself."""

    def fold(batch: DataFrame, number: int) -> None:
        batch.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{main}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def compact(spark: SparkSession, main: str, out: str) -> DataFrame:
    """All batches of main as one table sorted by source ranges at out."""
    rows = spark.read.parquet(main).drop("batch")
    rows.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("errorifexists").parquet(out)
    return spark.read.schema(rows.schema).parquet(out)


def event_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events by type and time window; events later than the watermark are dropped."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
