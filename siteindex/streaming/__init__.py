"""Structured Streaming extensions: append-only run logs and event-time windows.

The batch queries are the reference's; these are additions of this package.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and event-time window; later ones than the watermark are dropped."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def write_log(events: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet log, once for each file set (available-now trigger)."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_of_log(log: DataFrame, n: int = 25) -> DataFrame:
    """The last ``n`` events of a log in ascending order."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).orderBy("ts", "event_id")
