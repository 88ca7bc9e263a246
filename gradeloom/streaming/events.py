"""Windowed counts of events, the same over a table and over a stream; an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Count and total value by window and event type; ``late``: how late events of a stream may be before their window closes."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def write_windows(events: DataFrame, size: str, late: str, target: str, checkpoint: str):
    """Closed windows appended to Parquet files, each once, until no file is left; returns the query."""
    out = tumbling(events, size, late)
    return out.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
