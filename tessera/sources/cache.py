"""A cache of searches as a table: an entry for each (query, limit), hits or none, kept between runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import written

#: What a search gives for one (query, limit): its hits in order; none is an entry, too, and so is a failure.
ENTRY = "query string, `limit` int, hits array<struct<position:int,item_id:long>>, failed boolean"
COUNTERS = "run string, n_asked long, n_hits long, n_misses long, n_failed long"


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table's rows; none before the first write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """One entry for each (query, limit): the same search may have been written by two runs at once."""
    return _read(spark, f"{folder}/entries", ENTRY).dropDuplicates(["query", "limit"])


def counters(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/counters", COUNTERS)


def search(asked: DataFrame, folder: str, look_up: Callable[[DataFrame], DataFrame], run: str | None = None) -> DataFrame:
    """(query, limit, position, item_id) of all (query, limit) in `asked`, looked up only where the table has no entry.

    look_up: from a table of missing (query, limit) to their hits (query, limit, position, item_id, error); a query without a row,
    or with an error, becomes an empty entry, so that it is not asked for again. Each run appends what it has
    looked up and its counters.
    """
    spark, run = asked.sparkSession, run or uuid.uuid4().hex
    asked = written(asked.select("query", F.col("limit").cast("int").alias("limit")).distinct(), "asked")
    kept = entries(spark, folder)
    missing = written(asked.join(kept.select("query", "limit"), ["query", "limit"], "left_anti"), "missing")
    found = look_up(missing).select("query", F.col("limit").cast("int").alias("limit"), F.col("position").cast("int").alias("position"), F.col("item_id").cast("long").alias("item_id"), "error")
    hit = F.when(F.col("error").isNull(), F.struct("position", "item_id"))
    lists = found.groupBy("query", "limit").agg(F.array_sort(F.collect_list(hit)).alias("hits"), F.max(F.col("error").isNotNull()).alias("failed"))
    new = missing.join(lists, ["query", "limit"], "left").select("query", "limit", F.coalesce("hits", F.from_json(F.lit("[]"), "array<struct<position:int,item_id:long>>")).alias("hits"), F.coalesce("failed", F.lit(False)).alias("failed"))
    new = written(new, "entries")
    n_asked, (n_missing, n_failed) = asked.count(), new.agg(F.count("*"), F.count_if("failed")).first()
    own = kept.join(asked, ["query", "limit"], "left_semi").unionByName(new)
    out = written(own.select("query", "limit", F.explode("hits").alias("h")).select("query", "limit", "h.*"), "found")
    new.write.mode("append").parquet(f"{folder}/entries")
    spark.createDataFrame([(run, n_asked, n_asked - n_missing, n_missing, n_failed)], COUNTERS).coalesce(1).write.mode("append").parquet(f"{folder}/counters")
    return out
