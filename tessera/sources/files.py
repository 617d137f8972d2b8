"""Readers of JSON inputs, and a report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("item_id", "title", "artist", "album", "description", "source")] + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("match_confidence", T.DoubleType()), T.StructField("netease_song_id", T.LongType())])
PROFILE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("profile_id", "label")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("liked_artists", "genres", "moods", "tags")]
    + [T.StructField(c, T.DoubleType()) for c in ("content_weight", "novelty", "diversity")]
    + [T.StructField("k", T.IntegerType())]
)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON file with a list under `items`; ValueError where there is none."""
    got = spark.read.schema(T.StructType([T.StructField("items", T.ArrayType(ITEM))])).option("multiLine", True).json(path)
    if got.where(F.col("items").isNull()).limit(1).count():
        raise ValueError(f"{path} has no list of items")
    return got.select(F.explode("items").alias("i")).select("i.*")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Seed profiles: an object with a list under `profiles`, or the list alone; sliders and k get defaults."""
    wrapped = spark.read.schema(T.StructType([T.StructField("profiles", T.ArrayType(PROFILE)), *PROFILE.fields])).option("multiLine", True).json(path)
    rows = wrapped.where(F.col("profiles").isNotNull()).select(F.explode("profiles").alias("p")).select("p.*").unionByName(wrapped.where(F.col("profiles").isNull()).drop("profiles"))
    return rows.where(F.col("profile_id").isNotNull()).fillna({"content_weight": 0.5, "novelty": 0.3, "diversity": 0.3, "k": 10})


def write_report_table(rows: DataFrame, path: str) -> None:
    """A report of any size, as JSON lines."""
    rows.write.mode("overwrite").json(path)
