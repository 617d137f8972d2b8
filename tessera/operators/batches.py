"""Whole groups out of Arrow batches, for steps that need all rows of a request at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def starts(key: np.ndarray) -> np.ndarray:
    """First row of each run of equal keys, and the number of rows."""
    if not len(key):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def over_requests(rows: DataFrame, order: list, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """work(table, starts) on tables that hold whole requests, rows of each in the given order; many at a time.

    A window function puts a request's rows next to each other in one task. A table is a batch, and what is held over
    of a request that goes on in the next; a request's rows are bounded by its plan. Unlike grouped pandas, no request
    pays for a call of its own.
    """
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            at = starts(t.column("request_id").to_numpy())
            if len(at) > 2:
                yield from work(t.slice(0, at[-2]).combine_chunks(), at[:-1]).to_batches()
                t = t.slice(at[-2])
            held = t
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks(), starts(held.column("request_id").to_numpy())).to_batches()

    # the place is read, so that the window stays in the plan
    return placed.mapInArrow(lambda batches: run(b.drop_columns(["_place"]) for b in batches), schema)
