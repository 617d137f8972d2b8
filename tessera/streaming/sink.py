"""The feedback log's streaming sink: accepted and quarantined events, and the latest state of each request.

Every micro-batch writes its tables under its own number, replacing what an earlier attempt at the same number has left, so a
batch that is replayed after a failure changes nothing. Events that arrive twice are dropped by id within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import store


def write_batch(batch: DataFrame, number: int, folder: str, key: str = "request_id", order: tuple[str, ...] = ("ts", "event_id")) -> None:
    """One micro-batch: accepted and quarantined events, and the batch's last event of each key."""
    batch = batch.persist()
    try:
        good, bad = store.validate(batch)
        good.write.mode("overwrite").parquet(f"{folder}/accepted/batch={number}")
        bad.write.mode("overwrite").parquet(f"{folder}/quarantined/batch={number}")
        last = store.latest(good.where(F.col(key).isNotNull()), [key], list(order))
        last.write.mode("overwrite").parquet(f"{folder}/latest/batch={number}")
    finally:
        batch.unpersist()


def start(events: DataFrame, folder: str, checkpoint: str, late: str = "2 days", once: bool = True) -> StreamingQuery:
    """Run the sink on a stream of events (event_id, ts, request_id, event_type, ...): what is there, or (once=False) for good."""
    unique = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    writer = unique.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def accepted(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/accepted").drop("batch")


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/quarantined").drop("batch")


def latest(spark: SparkSession, folder: str, key: str = "request_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last event of each key: of the batches' last ones, so that what is compared is one row a key and batch."""
    return store.latest(spark.read.parquet(f"{folder}/latest").drop("batch"), [key], list(order))
