"""One place to build a session with the settings that all queries rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(master: str | None = None, partitions: int | None = None, app: str = "tracewell") -> SparkSession:
    """UTC, adaptive execution with skew handling; the shuffle width is the cluster's unless given."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local master gets one of its own where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracewell-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a table of accounts that may be broadcast.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df marked for broadcast where it has few rows; a table of all transfers that is joined with it stays where it lies then."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
