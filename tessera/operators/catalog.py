"""Catalogue search: postings, field weights, bonuses, order, and the display mode of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of a query token by field, and bonuses.
FIELD_WEIGHTS = {"artist": 5.0, "title": 4.0, "album": 2.0, "tags": 2.0, "description": 0.6}
WHOLE_QUERY, ALL_IN_NAME, CONFIDENCE = 6.0, 2.5, 1.5
# Least confidence of each display mode.
DISPLAY = (("full", 0.60), ("best-guess", 0.50), ("uncertain", 0.40))
SEARCH_STOP = ("a", "an", "the", "of", "and", "or", "to", "in", "on", "for", "by", "with", "from", "is", "was", "are", "be")


def search_tokens(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.filter(found, lambda t: ~t.isin(*SEARCH_STOP))


def search(items: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """The best items of each query (query_id, query): query_id, item columns, score, rank.

    items: item_id, title, artist, album, and if they exist tags, description, confidence. Items meet queries in shared
    tokens (explode and equi-join), so an item is scored only for queries it can match. Order: score, then id as text.
    """
    fields = [f for f in FIELD_WEIGHTS if f in items.columns]
    docs = items.withColumns({f"_{f}": F.array_distinct(search_tokens(F.col(f))) for f in fields})
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("q"), search_tokens(F.col("query")).alias("tokens"))
    postings = docs.select("item_id", F.explode(F.array_distinct(F.concat(*[f"_{f}" for f in fields]))).alias("token"))
    pairs = asked.select("query_id", F.explode(F.array_distinct("tokens")).alias("token")).join(postings, "token").select("query_id", "item_id").distinct()
    both = pairs.join(asked, "query_id").join(docs, "item_id")
    score = _score(fields)
    name = F.concat("_artist", "_title")
    whole = F.lower("artist").contains(F.col("q")) | F.lower("title").contains(F.col("q"))
    score = score + F.when(whole, WHOLE_QUERY).otherwise(0.0) + F.when(F.forall("tokens", lambda t: F.array_contains(name, t)), ALL_IN_NAME).otherwise(0.0)
    if "confidence" in items.columns:
        score = score + F.when(score > 0, F.coalesce(F.col("confidence"), F.lit(0.0)) * CONFIDENCE).otherwise(0.0)
    ranked = both.withColumn("score", F.round(score, 4)).where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("item_id").cast("string"))))
    return ranked.where(F.col("rank") <= max(1, limit)).select("query_id", *items.columns, "score", "rank")


def _score(fields: list[str]) -> Column:
    total = F.lit(0.0)
    for f in fields:
        total = total + FIELD_WEIGHTS[f] * F.size(F.filter("tokens", _in(f"_{f}")))
    return total


def _in(column: str):
    return lambda t: F.array_contains(F.col(column), t)


def display_mode(source: Column, song_id: Column, confidence: Column) -> Column:
    known = source.contains("netease") & song_id.isNotNull()
    out = None
    for mode, least in DISPLAY:
        ok = known & (F.coalesce(confidence, F.lit(0.0)) >= least)
        out = F.when(ok, mode) if out is None else out.when(ok, mode)
    return out.otherwise("internal")


#: Columns that only search and building need.
PLUMBING = ("rank", "query_id", "tokens")


def enrich(ids: DataFrame, items: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Left join of ids with the catalogue: its columns without plumbing ones, empties as null, and `display`.

    Ids that the catalogue lacks take the fallback's row, if there is one; the source defaults to "internal", and the
    display mode follows from source and confidence whatever the row says.
    """
    keep = [c for c in items.columns if c not in PLUMBING and c != "display"]
    clean = lambda df: df.select("item_id", *[(F.when(F.trim(c) != "", F.col(c)) if t == "string" else F.when(F.size(c) > 0, F.col(c)) if t.startswith("array") else F.col(c)).alias(c) for c, t in df.dtypes if c in keep and c != "item_id"])
    got = ids.join(clean(items), "item_id", "left")
    if fallback is not None:
        second = clean(fallback).withColumnsRenamed({c: f"_{c}" for c in keep if c != "item_id"})
        # a row of the catalogue is taken whole: the fallback only answers for ids without one
        known = items.select("item_id", F.lit(True).alias("_known"))
        got = got.join(known, "item_id", "left").join(second, "item_id", "left")
        got = got.select("item_id", *[F.when(F.coalesce("_known", F.lit(False)), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in keep if c != "item_id"])
    source = F.coalesce("source", F.lit("internal")) if "source" in keep else F.lit("internal")
    got = got.withColumn("source", source)
    confidence = F.col("confidence") if "confidence" in keep else F.lit(None).cast("double")
    return got.withColumn("display", display_mode(F.col("source"), F.col("item_id"), confidence))


def lookup(items: DataFrame, ids: DataFrame) -> DataFrame:
    """(item_id, known) of the ids, compared as text: whether the catalogue has each."""
    own = items.select(F.col("item_id").cast("string").alias("item_id"), F.lit(True).alias("known")).distinct()
    return ids.select(F.col("item_id").cast("string").alias("item_id")).join(own, "item_id", "left").fillna(False, ["known"])


def search_hit(rows: DataFrame, base_url: str) -> DataFrame:
    """Raw rows (all text but artists) as search hits: a bad id is 0 and has no URL, missing texts are empty."""
    item = F.coalesce(F.col("item_id").try_cast("bigint"), F.lit(0))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(item.alias("item_id"), text("title"), text("artist"), F.coalesce("artists", F.array().cast("array<string>")).alias("artists"), text("album"), text("cover_url"), F.when(item != 0, F.concat(F.lit(base_url), item.cast("string"))).otherwise("").alias("url"))
