"""Merging of search hits and the signals that come of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import ARTIST_TYPES, TASTE_TYPES
from tessera.functions import text as X


def merge_hits(hits: DataFrame, about: Iterable[str] = (), together: bool = False) -> DataFrame:
    """One row per (request, item) of hits with their queries' tokens: numbers of hits, names and types of sources, best and mean rank scores, positions.

    One shuffle, on the request: an item has few hits, so merging them before would save little, and all that follows works on
    whole requests and needs no further shuffle. A request's hits are bounded by its plan. about: columns that follow from the item.
    together: hits are dealt by request already.
    """
    value = X.clip01(F.col("reliability")) / (1 + 0.2 * F.greatest(F.lit(0), F.col("position")))
    name = F.concat_ws(":", "source_type", "query")
    merged = {
        "n_hits": F.count("*"),
        "n_names": F.collect_set(name),
        "sources": F.collect_list(F.struct("plan_idx", name.alias("name"))),
        "types": F.collect_set("source_type"),
        "first_hit": F.min(F.struct("plan_idx", "position")),
        "best_value": F.max(value),
        "mean_value": F.avg(value),
        "mean_position": F.avg("position"),
        "max_reliability": F.max("reliability"),
        "max_rank": F.max(1 / (1 + 0.2 * F.col("position"))),
        "taste_tokens": F.collect_list(F.when(F.col("source_type").isin(*TASTE_TYPES), F.col("query_tokens"))),
        "query_tokens": F.collect_list("query_tokens"),
    }
    finish = {
        "n_names": lambda c: F.size(c).cast("long"),
        "sources": lambda c: F.array_distinct(F.transform(F.array_sort(c), lambda s: s["name"])),
        "types": F.array_sort,
        "taste_tokens": lambda c: F.array_distinct(F.flatten(c)),
        "query_tokens": F.flatten,
    }
    if together:
        # one sort, and what follows from the item stays where it is; a groupBy would sort and pack all of it twice
        own = Window.partitionBy("request_id", "item_id").orderBy("plan_idx", "position")
        whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        got = hits.select("request_id", "item_id", *about, F.row_number().over(own).alias("_nth"), *[c.over(whole).alias(k) for k, c in merged.items()]).where("_nth = 1")
    else:
        got = hits.repartition("request_id").groupBy("request_id", "item_id").agg(*[c.alias(k) for k, c in merged.items()], *[F.any_value(c).alias(c) for c in about])
    return got.select("request_id", "item_id", *[finish[k](F.col(k)).alias(k) if k in finish else k for k in merged], *about)


def merge_tracks(hits: DataFrame) -> DataFrame:
    """(request_id, item_id, ...): what hits say of an item, title, artist, artists, album and cover_url as far as hits have them; of
    each the first that is not empty, in order of the searches and places. One shuffle, merged in each task first."""
    order = lambda ok: F.when(ok, F.struct("plan_idx", "position"))
    fields = [c for c in ("title", "artist", "artists", "album", "cover_url") if c in hits.columns]
    filled = {c: F.size(c) > 0 if c == "artists" else F.coalesce(F.col(c), F.lit("")) != "" for c in fields}
    empty = {c: F.array().cast(hits.schema[c].dataType) if c == "artists" else F.lit("") for c in fields}
    return hits.groupBy("request_id", "item_id").agg(*[F.coalesce(F.min_by(c, order(filled[c])), empty[c]).alias(c) for c in fields])


def merge_channels(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hits of two channels as one table; those of the second come after the first's."""
    last = F.lit(1 << 20)
    return first.unionByName(second.withColumn("plan_idx", F.col("plan_idx") + last))


def route_counts(hits: DataFrame, times: str | None = None) -> DataFrame:
    """Hits and distinct items by bucket of source type; times: a column that tells for how many hits a row stands."""
    bucket = (
        F.when(F.col("source_type").isin(*ARTIST_TYPES), "artist").when(F.col("source_type") == "title", "title")
        .when(F.col("source_type") == "discovery", "discovery").otherwise("tag")
    )
    return hits.groupBy(bucket.alias("bucket")).agg((F.sum(times) if times else F.count("*")).alias("n_hits"), F.count_distinct("item_id").alias("n_items"))
