"""Incremental execution: event-time windows, and resumable batches that write each piece once.

The studies themselves have no event time; windows and sessions are additions for the events table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The events table as a stream of files, so many for each batch; ``ts`` becomes a timestamp for watermarks."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) for each window; rows later than ``late`` are not waited for."""
    made = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer pause."""
    made = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first row, repeats within the watermark dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def write_pieces(stream: DataFrame, render: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Renders bounded batches and writes each under its number; a batch that is repeated after a failure overwrites
    itself, so every row is written once."""

    def one(batch: DataFrame, number: int) -> None:
        render(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
