"""What a page shows of requests and cards: presets of the sliders, lists from text, durations, chips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

# Sliders by preset.
PRESETS = {
    "safe": {"content_weight": 0.85, "novelty": 0.15, "diversity": 0.20},
    "balanced": {"content_weight": 0.60, "novelty": 0.40, "diversity": 0.50},
    "discovery": {"content_weight": 0.50, "novelty": 0.80, "diversity": 0.75},
}
MOST_CHIPS = 6


def sliders(preset: Column) -> Column:
    """The struct of a preset's sliders; null for an unknown one."""
    out = None
    for name, values in PRESETS.items():
        struct = F.struct(*[F.lit(v).alias(k) for k, v in values.items()])
        out = F.when(preset == name, struct) if out is None else out.when(preset == name, struct)
    return out


def parse_csv(raw: Column) -> Column:
    """Trimmed parts between commas; blanks go."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")


def https(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), "^(?i)http://", "https://")


def duration(ms: Column) -> Column:
    """minutes:seconds; empty for null, 0 and less."""
    total = F.floor(ms / 1000 + 0.5)
    return F.when(ms > 0, F.concat((total / 60).cast("bigint").cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"))).otherwise("")


def chips(reasons: Column, artist_match: Column, matched_tags: Column, tag_match: Column, sources: Column, agreement: Column, pick: Column, novelty: Column) -> Column:
    """Short labels of why a card is there, six at most; that of its pick type if nothing else can be said."""
    said = F.lower(F.array_join(reasons, " "))
    found = F.array_compact(F.array(
        F.when(said.contains("artist") | (artist_match > 0.5), "same artist"), F.when((F.size(matched_tags) > 0) | (tag_match > 0), "matched genre"), F.when(said.contains("mood"), "matched mood"),
        F.when((F.size(sources) > 1) | (agreement > 0), "multi-source match"), F.when((pick == "exploratory") | (novelty > 0.25), "discovery pick"), F.when(pick == "diverse", "diversity pick"),
    ))
    return X.let(found, lambda c: F.when((F.size(c) == 0) & (pick != ""), F.array(F.concat(pick, F.lit(" pick")))).otherwise(F.slice(F.array_distinct(c), 1, MOST_CHIPS)))
