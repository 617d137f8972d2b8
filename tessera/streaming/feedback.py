"""Feedback as a stream: validated events in daily windows with a watermark for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.store import EVENT_TYPES, event_type


def read_events(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n) of valid events; state is kept for days that the watermark has not passed."""
    got = events.withColumn("event_type", event_type(F.col("event_type"))).where(F.col("event_type").isin(*EVENT_TYPES))
    return got.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def run_to_memory(counts: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Process what is there, then stop; for tests and backfills."""
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)
