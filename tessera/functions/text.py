"""Text functions over columns: tokens, normal forms, phrases, sets. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import STOP_WORDS, VERSION_WORDS

#: Runs of ASCII letters and digits or common CJK ideographs.
TOKEN = "[A-Za-z0-9一-鿿]+"
#: Bracketed spans, ASCII and full-width, shortest first.
BRACKETS = "[(\\[{（【].*?[)\\]}）】]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, though body names it often or within a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def raw_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, repeats kept; no stop words, none of one character."""
    return F.filter(raw_tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def norm_artist(name: Column) -> Column:
    return F.array_join(tokens(name), " ")


def norm_title(title: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), BRACKETS, " ")
    return F.coalesce(F.nullif(F.array_join(tokens(bare), " "), F.lit("")), F.array_join(tokens(title), " "))


def has_version_word(title: Column) -> Column:
    return F.exists(raw_tokens(title), lambda t: t.isin(*VERSION_WORDS))


def starts_with(a: Column, b: Column) -> Column:
    """Whether token array a begins with the tokens of b."""
    return (F.size(b) > 0) & (F.slice(a, 1, F.size(b)) == b)


def contains_phrase(a: Column, b: Column) -> Column:
    """Whether the tokens of b stand next to each other in a."""
    wrap = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(b) > 0) & wrap(a).contains(wrap(b))


def without(tokens_: Column, gone: Column) -> Column:
    # a difference of sets is far cheaper than a search for each token; it drops repeats, so it serves where there are none
    kept = F.filter(tokens_, lambda t: ~F.array_contains(gone, t))
    return F.when(F.size(F.array_distinct(tokens_)) == F.size(tokens_), F.array_except(tokens_, gone)).otherwise(kept)


def strip_tag_terms(title: Column, tag_tokens: Column) -> Column:
    """The title's tokens without the tags', as text; the title as it is if there are no tag tokens."""
    return F.when(F.size(tag_tokens) == 0, title).otherwise(F.array_join(without(tokens(title), tag_tokens), " "))


def joined_text(*parts: Column) -> Column:
    """All tokens of all parts, as one text; repeats stay."""
    return F.array_join(F.concat(*[tokens(p) for p in parts]), " ")


def json_object(raw: Column, schema: str) -> Column:
    """The parsed object; an empty one (all fields null) for null or invalid text."""
    return F.from_json(F.coalesce(raw, F.lit("{}")), schema)


def string_list(values: Column, most: int) -> Column:
    """Trimmed texts, the first of each in any case, at most `most`; null is an empty list."""
    some = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
    return F.transform(F.slice(dedupe_keep_order(some), 1, most), lambda v: F.trim(v))


def int_list(values: Column, most: int) -> Column:
    """Whole numbers but 0 of texts, the first of each, at most `most`; what is no number goes."""
    numbers = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.try_cast("bigint"))
    return F.slice(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n != 0))), 1, most)


def _firsts(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first of each key, in order; empty keys go. Keys are made once an element."""
    kept = lambda vs: let(F.transform(vs, key), lambda keys: F.filter(vs, lambda v, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1)))
    return let(values, kept)


def dedupe_phrases(phrases: Column) -> Column:
    """The first phrase of each normal form, trimmed, in order; phrases without a token go."""
    return F.transform(_firsts(phrases, norm_artist), lambda p: F.trim(p))


def dedupe_keep_order(values: Column) -> Column:
    """The first of each trimmed lower-case form; blanks go."""
    return _firsts(values, lambda v: F.lower(F.trim(v)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens; 0 if either side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def coverage(wanted: Column, found: Column) -> Column:
    """Share of the wanted tokens among the found; 0 if none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, found)) / F.size(wanted)).otherwise(F.lit(0.0))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x.cast("double"), F.lit(0.0))))


def maybe_int(x: Column) -> Column:
    return x.try_cast("long")


def maybe_float(x: Column) -> Column:
    return x.try_cast("double")


def json_list(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
