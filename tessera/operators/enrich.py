"""Platform signals: which items are looked up, and how raw fields become signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Grade by level, and by least bitrate.
LEVELS = {"hires": 1.0, "jyeffect": 1.0, "lossless": 1.0, "exhigh": 1.0, "higher": 0.8, "standard": 0.8, "medium": 0.6, "low": 0.4}
BITRATES = ((999_000, 1.0), (320_000, 0.85), (192_000, 0.70), (128_000, 0.55))


def budget(k: int) -> int:
    return max(6, min(16, 2 * k))


def within_budget(scored: DataFrame, k: int) -> DataFrame:
    """The best budget(k) rows of each request by score, title, id, with their place."""
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "title", "item_id"))
    return scored.withColumn("place", place).where(F.col("place") <= budget(k))


def any_known(columns: list[tuple[str, str]]) -> Column:
    """Whether any signal (name, type) is present: not null, and texts and lists not empty; false counts."""
    present = F.lit(False)
    for name, kind in columns:
        ok = F.col(name).isNotNull()
        if kind == "string" or kind.startswith("array"):
            ok = ok & ((F.length(name) if kind == "string" else F.size(name)) > 0)
        present = present | F.coalesce(ok, F.lit(False))
    return present


def attach(rows: DataFrame, signals: DataFrame, within: Column | None = None) -> DataFrame:
    """Left join by item; `enriched` tells whether any signal is known. Rows outside `within` get none."""
    known = [(c, k) for c, k in signals.dtypes if c != "item_id"]
    got = rows.join(signals, "item_id", "left")
    if within is not None:
        got = got.withColumns({c: F.when(within, F.col(c)) for c, _ in known})
    return got.withColumn("enriched", any_known(known))


def to_payload(rows: DataFrame, signals: list[str]) -> DataFrame:
    """(item_id, payload): the signals as JSON text, nulls left out, as a cache keeps them."""
    return rows.select("item_id", F.to_json(F.struct(*signals)).alias("payload"))


def from_payload(rows: DataFrame, schema: str) -> DataFrame:
    """The signals of to_payload's rows again; invalid text gives nulls."""
    return rows.select("item_id", F.from_json("payload", schema).alias("p")).select("item_id", "p.*")


def deep(lyric: Column, similar: Column, words: int = 160, most: int = 20) -> tuple[Column, Column]:
    """(excerpt of a lyric, similar ids): the first words and ids, for plans that look that deep."""
    found = F.filter(F.split(F.trim(F.coalesce(lyric, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(found, 1, words), " "), F.slice(F.filter(F.coalesce(similar, F.array().cast("array<bigint>")), lambda i: i != 0), 1, most)


def first_truthy(*values: Column) -> Column:
    """The first that is neither null nor zero; else the last as it is."""
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values[:-1]], values[-1])


def playable(url: Column, code: Column, fee: Column) -> Column:
    return (F.coalesce(url, F.lit("")) != "") & (code.isNull() | (code == 200)) & F.coalesce(fee != 1, F.lit(True))


def audio_grade(level: Column, bitrate: Column) -> Column:
    out = None
    for name, grade in LEVELS.items():
        out = F.when(level == name, grade) if out is None else out.when(level == name, grade)
    for least, grade in BITRATES:
        out = out.when(bitrate >= least, grade)
    return out.when(bitrate.isNotNull(), 0.35)
