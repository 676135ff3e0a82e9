"""Event-time windows and a landing zone for snapshots; the same transforms serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """(window, event_type, n, total): tumbling windows of event time; streams need a watermark."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def landing_zone(spark: SparkSession, path: str, schema: str, token: str = "token", at: str = "crawled_at", late: str = "30 days") -> DataFrame:
    """A stream of JSON lines from a folder, each token once within the lateness."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([token])
