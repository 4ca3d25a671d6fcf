"""Streaming detection: a ledger stream, windows with a watermark, and alerts written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "txn_id long, src long, dst long, amount double, ts timestamp, channel string"


def read_ledger_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive; the checkpoint remembers which were read."""
    return spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each txn_id once within the watermark; state older than that is dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["txn_id"])


def windowed_bands(stream: DataFrame, lower: float, upper: float, min_count: int = 3, window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Structuring per account and event-time window; late rows count until the watermark has passed."""
    band = stream.withWatermark("ts", delay).where((F.col("amount") >= lower) & (F.col("amount") < upper))
    hits = band.groupBy("src", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return hits.where(F.col("n") >= min_count).select("src", F.col("w.start").alias("start"), "n", "total")


def split_quarantine(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rows for the quarantine table)."""
    good = F.coalesce(F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("ts").isNotNull() & (F.col("amount") > 0), F.lit(False))
    return batch.where(good), batch.where(~good)


def run_batches(stream: DataFrame, out: str, checkpoint: str, detect) -> StreamingQuery:
    """Run detect(valid rows) on each micro-batch and write its alerts under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so alerts are there exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split_quarantine(batch)
        detect(good).write.mode("overwrite").parquet(f"{out}/alerts/batch={number}")
        bad.write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
