"""Scores as column expressions; unknown signals get priors, so unknown is not zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import ARTIST_TYPES, CROSS_TASTE_TYPES, WEIGHTS, Weights
from tessera.functions import text as X


def some(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def metadata_quality(title: Column, artist: Column, album: Column, cover: Column, item_id: Column) -> Column:
    part = lambda ok, w: F.when(ok, F.lit(w)).otherwise(F.lit(0.0))
    total = part(some(title), 0.35) + part(some(artist), 0.30) + part(some(album), 0.15) + part(some(cover), 0.10) + part(F.coalesce(item_id, F.lit(0)) != 0, 0.10)
    return F.least(F.lit(1.0), F.round(total, 9))  # without the last bit, which a threshold could hang on


def retrieval_confidence(best: Column, mean: Column, metadata: Column) -> Column:
    return F.least(F.lit(1.0), (0.7 * best + 0.3 * mean) * (0.8 + 0.2 * metadata))


def agreement(n_names: Column, types: Column, n_similar: Column | None = None) -> Column:
    """How many independent searches found an item; n_similar: how many similar ids are known of it (null or 0: none)."""
    among = lambda kinds: F.exists(types, lambda t: t.isin(*kinds))
    cross = F.when(among(ARTIST_TYPES) & among(CROSS_TASTE_TYPES), 1.0).otherwise(0.0)
    score = 0.4 * F.least(F.lit(1.0), n_names / 4) + 0.3 * F.least(F.lit(1.0), F.size(types) / 4) + 0.3 * cross
    score = F.when(F.size(types) == 0, 0.0).when(F.forall(types, lambda t: t == "title"), score * 0.35).otherwise(score)
    if n_similar is not None:
        score = F.when(n_similar > 0, 0.85 * score + F.least(F.lit(0.20), n_similar / 100)).otherwise(score)
    return F.least(F.lit(1.0), score)


def artist_affinity(artist_match: Column, norms: Column, weights: Column, artists: Column) -> Column:
    """The match, or the largest weight among the item's artists (array of normal forms), whichever is larger."""
    own = F.transform(artists, lambda a: F.coalesce(F.get(weights, F.array_position(norms, a).cast("int") - 1), F.lit(0.0)))
    return F.greatest(artist_match, F.coalesce(F.array_max(own), F.lit(0.0)))


def popularity(comments: Column, hot: Column, red: Column, enriched: Column) -> Column:
    zero = lambda c: F.greatest(F.lit(0), F.coalesce(c, F.lit(0)))
    raw = zero(comments) + 3.0 * zero(hot) + 0.5 * zero(red)
    return F.when(~enriched, 0.55).when(raw <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(raw) / F.log1p(F.lit(5000.0))))


def authority(followers: Column, enriched: Column) -> Column:
    return F.when(~enriched | followers.isNull(), 0.55).when(followers <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(followers.cast("double")) / F.log1p(F.lit(500000.0))))


def playable(known: Column, enriched: Column) -> Column:
    return F.when(~enriched | known.isNull(), 0.60).when(known, 1.0).otherwise(0.0)


def audio_quality(grade: Column) -> Column:
    return F.when(grade.isNull(), 0.60).otherwise(X.clip01(grade))


def trust(meta: Column, pop: Column, auth: Column, play: Column, agree: Column, conf: Column) -> Column:
    return F.least(F.lit(1.0), 0.20 * meta + 0.20 * pop + 0.20 * auth + 0.15 * play + 0.15 * agree + 0.10 * conf)


def novelty(known_artist: Column, mean_position: Column, tag_match: Column, has_tags: Column, seed_album: Column) -> Column:
    share = F.greatest(tag_match, F.when(has_tags, 0.30).otherwise(0.0))
    return X.clip01(0.35 * (1 - known_artist) + 0.25 * F.least(F.lit(1.0), mean_position / 8) + 0.25 * share + 0.15 * (1 - seed_album))


def blend(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = None
    for k, w in weights.items():
        total = w * parts[k] if total is None else total + w * parts[k]
    return F.least(F.lit(1.0), total)


def final(content: Column, retrieval: Column, quality: Column, auth: Column, novel: Column, content_weight: Column, novelty_weight: Column, w: Weights = WEIGHTS) -> tuple[Column, Column, Column]:
    """(base relevance, gate, final score)."""
    personal = content_weight * content + (1 - content_weight) * retrieval
    base = blend({"personal": personal, "quality": quality, "authority": auth}, w.base)
    gate = F.least(F.lit(1.0), base / w.gate_divisor)
    return base, gate, X.clip01(base + novelty_weight * novel * gate)
