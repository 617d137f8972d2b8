"""Candidate filters; each marks rows, so that one pass can both drop and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import TASTE_TYPES
from tessera.functions import text as X

WEAK_TAG_TYPES = tuple(t for t in TASTE_TYPES if t != "artist_context")


def liked_or_excluded() -> Column:
    return F.array_contains("liked_ids", F.col("item_id"))


def missing_metadata(alive: Column | None = None) -> Column:
    """Blank title or artist, where the request has a complete candidate."""
    full = (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("artist", F.lit(""))) != "")
    return ~full & F.max(full if alive is None else full & alive).over(Window.partitionBy("request_id"))


def liked_title_variant() -> Column:
    semantic = F.filter(X.raw_tokens(F.col("title")), lambda t: ~t.isin(*X.STOP_WORDS))
    near = X.let(semantic, lambda words: F.exists("title_norms", lambda k: X.starts_with(words, F.split(k, " ")) | X.contains_phrase(words, F.split(k, " "))))
    return F.array_contains("title_norms", X.norm_title(F.col("title"))) | (X.has_version_word(F.col("title")) & near)


def tag_title() -> Column:
    key, words = X.norm_title(F.col("title")), X.token_set(F.col("title"))
    other = F.array_union(X.token_set(F.col("artist")), X.token_set(F.col("album")))
    literal = F.array_contains("tag_norms", key)
    weak = F.forall("types", lambda t: t.isin(*WEAK_TAG_TYPES))
    return (key != "") & (literal | (F.arrays_overlap(words, F.col("tag_tokens")) & weak & ~F.arrays_overlap(other, F.col("tag_tokens"))))


def duplicate_version(alive: Column | None = None) -> Column:
    """Not the best of its (title, artist); the best has the most reliable hit, then rank, then metadata, then came first.

    Versions stay where the profile asks for some (wants_versions) and the title names one.
    """
    title, artist = X.norm_title(F.col("title")), X.norm_artist(F.col("artist"))
    meta = sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("title", "artist", "album")), F.lit(0))
    best = Window.partitionBy("request_id", title, artist, *([] if alive is None else [alive])).orderBy(F.desc("max_reliability"), F.desc("max_rank"), F.desc(meta), "first_hit", "item_id")
    wanted = F.col("wants_versions") & X.has_version_word(F.col("title"))
    return (title != "") & (artist != "") & (F.row_number().over(best) > 1) & ~wanted


def unplayable() -> Column:
    return ~F.coalesce("playable", F.lit(True))


def low_trust(agreement: Column, confidence: Column, popularity: Column, authority: Column, enriched: Column) -> Column:
    few = (F.col("comments") < 10) & (F.col("followers") < 77) & (agreement <= 0.35) & (confidence <= 0.55)
    weak = (popularity <= 0.05) & (authority <= 0.05) & (agreement < 0.25) & (confidence < 0.45)
    return enriched & (F.coalesce(few, F.lit(False)) | weak)


def before_signals(rows: DataFrame) -> DataFrame:
    """rows with `dropped`: the first rule, of those that need no signals, that drops the row; null for those that stay.

    A rule sees only what the rules before it have left.
    """
    alive = F.col("dropped").isNull()
    rows = rows.withColumn("dropped", F.when(liked_or_excluded(), "liked"))
    for name, bad in (("missing_metadata", missing_metadata(alive)), ("same_title", liked_title_variant()), ("tag_title", tag_title()), ("duplicate_version", duplicate_version(alive))):
        rows = rows.withColumn("dropped", F.coalesce("dropped", F.when(bad, name)))
    return rows


def after_signals(rows: DataFrame) -> DataFrame:
    """rows with `dropped` of the rules that need signals and scores."""
    c = F.col
    trust = low_trust(c("agreement"), c("confidence"), c("popularity"), c("authority"), c("enriched"))
    return rows.withColumn("dropped", F.when(unplayable(), "unplayable").when(trust, "low_trust"))


def funnel(rows: DataFrame) -> DataFrame:
    """(rule, n): rows that each rule drops, by `dropped`, and those that stay."""
    return rows.groupBy(F.coalesce("dropped", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))
