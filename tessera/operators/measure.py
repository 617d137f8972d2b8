"""Stages of a run, each written as a table and measured as it is written: time, rows, and failures."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "place int, stage string, ms double, n_rows long, error string, optional boolean"


class Stages:
    """Writes stages under a folder. Records have a row per stage: a handful, whatever the data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.records = spark, folder.rstrip("/"), []

    def _record(self, name: str, start: float, rows: int | None, error: str | None, optional: bool) -> None:
        self.records.append((len(self.records), name, (time.perf_counter() - start) * 1000, rows, error, optional))

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Build and write a stage, and read it back; its rows are told by the footers of its files.

        Not by observe(): a session that has observed once can't send fitted models of pyspark.ml to tasks any more.
        """
        start, path = time.perf_counter(), f"{self.folder}/{len(self.records):02d}-{name.replace(' ', '-')}"
        try:
            df = build()
            df.write.parquet(path)
            back = self.spark.read.schema(df.schema).parquet(path)
            rows = back.count()
        except Exception as e:
            self._record(name, start, None, f"{type(e).__name__}: {e}".splitlines()[0], False)
            raise
        self._record(name, start, rows, None, False)
        return back

    def sink(self, name: str, write: Callable[[], int | None]) -> bool:
        """A write that the result does not hang on: a failure is recorded, and the run goes on. write may return rows written."""
        start = time.perf_counter()
        try:
            rows, error = write(), None
        except Exception as e:  # whatever a sink raises is its record
            rows, error = None, f"{type(e).__name__}: {e}".splitlines()[0]
        self._record(name, start, rows, error, True)
        return error is None

    def latencies(self) -> dict[str, float]:
        return {name: ms for _, name, ms, *_ in self.records}

    def report(self) -> DataFrame:
        return self.spark.createDataFrame(self.records, RECORDS)


def health(report: DataFrame) -> DataFrame:
    """(n_success, n_failure, healthy, last_error) of a report's sinks; healthy until the first failure."""
    sinks = report.where("optional")
    got = sinks.agg(F.count_if(F.col("error").isNull()).alias("n_success"), F.count_if(F.col("error").isNotNull()).alias("n_failure"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("place"))).alias("last_error"))
    return got.withColumn("healthy", F.col("n_failure") == 0)
