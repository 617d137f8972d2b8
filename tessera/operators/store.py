"""The feature store and the feedback log as tables: keyed merge, latest rows, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import NEGATIVE_EVENTS, NEUTRAL_EVENTS, POSITIVE_EVENTS

EVENT_TYPES = (*POSITIVE_EVENTS, *NEGATIVE_EVENTS, *NEUTRAL_EVENTS)


def upsert(old: DataFrame, new: DataFrame, key: str = "item_id") -> DataFrame:
    """Keyed merge: seen count adds up, first_seen stays, last_seen is new, lists unite, other values are new else old.

    One full outer join of tables with one row a key; write the result to a new version, never over the table that is
    being read. The new side comes from observed().
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    c = lambda x: (F.col(f"o.{x}"), F.col(f"n.{x}"))

    def merged(name: str) -> Column:
        a, b = c(name)
        if name == "seen":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        if name == "first_seen":
            return F.coalesce(a, b)
        if dict(old.dtypes)[name].startswith("array"):
            return F.array_union(F.coalesce(a, F.array().cast(dict(old.dtypes)[name])), F.coalesce(b, F.array().cast(dict(old.dtypes)[name])))
        return F.coalesce(b, a)

    return joined.select(*[merged(name).alias(name) for name in old.columns])


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def event_type(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) feedback; types are trimmed and in lower case."""
    got = events.withColumn("event_type", event_type(F.col("event_type")))
    good = F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    return got.where(good), got.where(~good)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def texts(store: DataFrame) -> DataFrame:
    """(item_id, text_for_embedding) of the rows that have text."""
    return store.where(F.trim(F.coalesce("text_for_embedding", F.lit(""))) != "").select("item_id", "text_for_embedding")


def text_for_embedding(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def observed(hits: DataFrame, scores: DataFrame, seen_at: Column) -> DataFrame:
    """The new side of an upsert: a row for each item of hits, with the texts and types of the queries that found it.

    The query of semantic recall is no text of the item, so it stays out of query_texts; its type is kept. scores
    (item_id, ...) are joined as they are. tags and duration_ms are kept in the schema and never filled.
    """
    said = F.when(F.col("source_type") != "embedding", F.col("query"))
    got = hits.groupBy("item_id").agg(F.lit(1).alias("seen"), F.array_sort(F.collect_set(said)).alias("query_texts"), F.array_sort(F.collect_set("source_type")).alias("source_types"))
    got = got.withColumns({"first_seen": seen_at, "last_seen": seen_at, "tags": F.array().cast("array<string>"), "duration_ms": F.lit(None).cast("long")})
    return got.join(scores, "item_id", "left")


def lookup(store: DataFrame, ids: DataFrame, key: str = "item_id") -> DataFrame:
    """The store's rows of the ids (get and has: a row, or none)."""
    return store.join(ids.select(key).distinct(), key, "left_semi")


def as_track(store: DataFrame) -> DataFrame:
    """Stored rows in the shape of a search hit; the first artist is the main one."""
    return store.select("item_id", "title", F.coalesce(F.get("artists", 0), F.lit("")).alias("artist"), "artists", "album", "cover_url", F.lit(None).cast("long").alias("duration_ms"))


def as_record(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Raw text rows as records of the schema: casts that turn bad values to null; lists are JSON text, bad ones empty.

    A boolean is unknown, false or true: null, 0 or anything else.
    """
    def cast(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("array"):
            return F.coalesce(F.from_json(c, kind), F.array().cast(kind))
        if kind == "boolean":
            return c.try_cast("int") != 0
        return F.coalesce(c, F.lit("")) if kind == "string" else c.try_cast(kind)

    return rows.select(*[cast(n, k).alias(n) for n, k in schema.items()])


def read_feedback(items: DataFrame, events: DataFrame, request_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exposed items by rank, events by time) of some requests; their places are columns, so the order survives a write."""
    own = request_ids.select("request_id").distinct()
    nth = lambda *order: F.row_number().over(Window.partitionBy("request_id").orderBy(*order))
    return items.join(own, "request_id", "left_semi").withColumn("place", nth("rank", "item_id")), events.join(own, "request_id", "left_semi").withColumn("place", nth("ts", "event_id"))


#: Columns of the exposure log's items.
EXPOSURE = ("request_id", "item_id", "rank", "score", "rank_score", "content", "retrieval", "agreement", "quality", "novelty", "types", "reasons", "pick")


def exposures(cards: DataFrame) -> DataFrame:
    """A row for each card shown; returning a card counts as an impression. Appended as it is: replays are not merged."""
    return cards.select(*EXPOSURE).withColumn("was_impressed", F.lit(True))


def write_health(accepted: DataFrame, quarantined: DataFrame) -> DataFrame:
    """(n_success, n_failure, healthy) of a batch of events: what was accepted and what was not; healthy until the first failure."""
    both = accepted.select(F.lit(1).alias("ok")).unionByName(quarantined.select(F.lit(0).alias("ok")))
    got = both.agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("n_success"), F.count_if(F.col("ok") == 0).alias("n_failure"))
    return got.withColumn("healthy", F.col("n_failure") == 0)


def with_ids(events: DataFrame) -> DataFrame:
    """Feedback rows with a random id each."""
    return events.withColumn("feedback_id", F.expr("uuid()"))
