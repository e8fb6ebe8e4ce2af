"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class NoSharedFolder(RuntimeError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names.

    Where the session names none, a temporary one is set if all runs on this machine (as
    in tests); on a cluster that is an error, for its machines share no such folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "strataform-checkpoints"))
    return context.getCheckpointDir()


def working_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application's own."""
    return f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: cuts the lineage."""
    path = working_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove what this application wrote with working_path. Results that are read from
    there must have been written elsewhere before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text):
    """Lower-case A-Z only; the other letters stay. Pure ASCII takes the faster path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, A_Z, a_z))


def barrier(df: DataFrame, **columns) -> DataFrame:
    """df with further columns, each computed once per row.

    A plain withColumns may be merged into its consumers, and an expression inside a
    lambda is then evaluated for each element; a one-row generator is never merged.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores, so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
