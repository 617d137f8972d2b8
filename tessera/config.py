"""Weights, thresholds and vocabularies. Values without public evidence are defaults of ours, kept here to be changed."""

from __future__ import annotations

from dataclasses import dataclass, field

# Stop words and version words of titles.
VERSION_WORDS = ("live", "cover", "acoustic", "instrumental", "demo", "radio", "karaoke", "mono", "stereo", "remix", "version", "edit", "mix", "remastered", "remaster")
STOP_WORDS = ("a", "an", "the", "of", "and", "or", "to", "in", "on", "for", "by", "with", "from", "is", "was", "are", "be", "feat", "ft", "vs", *VERSION_WORDS)
# Source types by role.
SOURCE_TYPES = ("artist", "artist_context", "genre", "mood", "tag", "genre_mood", "tag_combo", "seed_song", "seed_album", "title", "discovery", "embedding")
TASTE_TYPES = ("artist_context", "genre", "mood", "tag", "genre_mood", "tag_combo", "discovery")
#: The artist and taste sides of agreement: artist_context counts as an artist's.
ARTIST_TYPES = ("artist", "artist_context", "seed_song", "seed_album")
CROSS_TASTE_TYPES = ("genre", "mood", "tag", "genre_mood", "tag_combo", "discovery")
PICK_TYPES = ("safe", "exploratory", "diverse", "balanced")
# Feedback event types.
POSITIVE_EVENTS = {"like": 1.0, "add_to_playlist": 1.0, "open_netease_url": 0.7, "play_preview": 0.7, "click": 0.7, "why_clicked": 0.5}
NEGATIVE_EVENTS = ("dislike", "not_interested", "skip")
NEUTRAL_EVENTS = ("impression",)


@dataclass(frozen=True)
class Weights:
    content: dict[str, float] = field(default_factory=lambda: {"text": 0.35, "artist": 0.30, "tag": 0.25, "title": 0.10})
    retrieval: dict[str, float] = field(default_factory=lambda: {"confidence": 0.45, "agreement": 0.55})
    quality: dict[str, float] = field(default_factory=lambda: {"popularity": 1 / 3, "authority": 1 / 3, "playable": 1 / 6, "metadata": 1 / 6})
    base: dict[str, float] = field(default_factory=lambda: {"personal": 0.70, "quality": 0.20, "authority": 0.10})
    gate_divisor: float = 0.55
    embedding_reliability: float = 0.68
    weak_negative_weight: float = 0.3
    min_samples: int = 50


WEIGHTS = Weights()
