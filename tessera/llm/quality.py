r"""Quality rules: cross-document line frequency, with per-document base rules.

Lines (\n-split, with a word) are normalised: A-Z to lower case, digits to 0, white space runs to one. For each host a
line counts the distinct documents that hold it, whatever stands around it; exact copies of a whole text, by its hash,
are one document, so they don't turn its lines into boilerplate. Lines above the limit are removed; a document that then
has too few words, or too small a share of its words, is rejected.

Null text: no words, base_failed. Null host: a host of its own. Repeated rows: each gets its result; they count once in
the counts. Empty table: empty result. Clashing column names: only the id, text and host columns are read.

A word is a run of [^\x20\x09-\x0D]; symbols are [#*$%&|<>]. Lines are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import join_ids
from tessera.llm.shared import fresh_name, materialise
from tessera.llm.words import LOWER, SPACE, Words, hash_runs, hash_spans, pieces

#: Distinct documents of one host that a line may appear in.
MAX_DOCS = 20
#: Words that must be left, as a number and as a share.
MIN_WORDS, MIN_LEFT = 50, 0.5
MAX_REPEAT = 50
WINDOW = 3

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
FOLD = LOWER.copy()
FOLD[48:58] = 48
EXACT = np.arange(256, dtype=np.uint8)

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of flags set in [at[i], at[i + 1]) for each i."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), at))


def _first_seen(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, key): whether it is the first with its values, and how many have them."""
    order = np.lexsort((np.arange(len(key)), key, text))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])
    first, count = np.empty(len(key), bool), np.empty(len(key), np.int64)
    first[order] = new
    group = np.cumsum(new) - 1
    count[order] = np.bincount(group, minlength=group[-1] + 1 if len(group) else 0)[group] if len(group) else 0
    return first, count


class Lines:
    """Lines with a word: text number, first and end word, hash as it stands, and hash of the normalised words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, w: Words):
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([at[:-1][at[:-1] < at[1:]], breaks + 1]))
        starts = starts[starts < len(data)]
        # a line ends at its break, or where its text ends
        ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], at[np.searchsorted(at, starts, "right")])
        a, b = np.searchsorted(w.start, starts), np.searchsorted(w.start, ends)
        has = b > a
        starts, ends, self.first, self.end = starts[has], ends[has], a[has], b[has]
        self.text = np.searchsorted(at, starts, "right") - 1
        self.exact = hash_spans(data, starts, ends, EXACT)
        self.folded = hash_runs(hash_spans(data, w.start, w.end, FOLD), self.first, self.end)


def _stats(data: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], Lines]:
    w = Words(data, at, EXACT)
    lines = Lines(data, at, w)
    letters = ~SPACE[data] & ((data & 0xC0) != 0x80)  # white space is ASCII: what else starts a code point is in a word
    again = np.bincount(lines.text[~_first_seen(lines.text, lines.exact)[0]], minlength=len(at) - 1)
    h, text, at_word = w.shingles(WINDOW)
    many = at_word[_first_seen(text, h)[1] > 1]
    repeated = np.zeros(len(w.start), bool)
    for k in range(WINDOW):
        repeated[many + k] = True
    return [np.diff(w.first), _per_text(letters, at), _per_text(SYMBOL[data], at), again, _per_text(repeated, w.first)], lines


def _key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("\0")))


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row for each row of docs: n (its number), id, host, key (a hash of the text), base figures, and lines array<struct<line, words>>.

    One pass over the texts, kept in the shared folder without them: a line is a hash and a count.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in pieces(batch.column("text")):
                stats, lines = _stats(data, at)
                at_line = np.searchsorted(lines.text, np.arange(b - a + 1))
                nested = pa.ListArray.from_arrays(
                    pa.array(at_line, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(lines.folded.view(np.int64)), pa.array((lines.end - lines.first).astype(np.int32))], ["line", "words"]),
                )
                rows = [batch.column(c).slice(a, b - a) for c in ("n", "id", "host", "key")]
                yield pa.RecordBatch.from_arrays([*rows, *map(pa.array, stats), nested], ["n", "id", "host", "key", *(x.split()[0] for x in _STATS.split(", ")), "lines"])

    got = docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), _key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return materialise(got.mapInArrow(run, f"n long, id {kind}, host string, key long, {_STATS}, lines array<struct<line:long,words:int>>"), "quality")


def frequent_lines(seen: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line) of the lines that more than max_docs distinct documents of a host hold."""
    each = seen.select("host", "key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    # the first aggregation merges copies of a text; the second is on a part of its key
    once = each.groupBy("host", "line", "key").agg(F.lit(1).alias("one"))
    return once.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs).select("host", "line")


def assess(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT, with_key: bool = False) -> DataFrame:
    """One row per row of docs: id, n (its number in a pass), base figures, n_words_left, base_failed, kept."""
    seen = measure(docs, id_col, text_col, host_col)
    frequent = frequent_lines(seen, max_docs)
    seen = seen if with_key else seen.drop("key")
    lines = seen.select("n", "host", F.explode("lines").alias("x")).select("n", "host", "x.line", "x.words")
    # (host, line) is unique on the right side: the join makes no more rows than there are lines
    lost = lines.join(frequent, (lines.host.eqNullSafe(frequent.host)) & (lines.line == frequent.line), "left_semi").groupBy("n").agg(F.sum("words").alias("lost"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return (
        seen.drop("lines", "host" if not with_key else "").join(lost, "n", "left")
        .withColumn("n_words_left", left).withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= min_left * F.col("n_words")))
        .drop("lost").withColumnRenamed("id", id_col)
    )


def keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of docs, all columns, that the rules keep.

    Rows of one id, text and host have one verdict; rejected ones are joined away by (id, text hash, host), broadcast
    only if they are few.
    """
    verdict = assess(docs, id_col=id_col, text_col=text_col, host_col=host_col, with_key=True, **limits)
    nulls = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    name = fresh_name(docs)
    go = materialise(verdict.where("NOT kept").select(F.struct(nulls(id_col).alias("id"), F.col("key"), nulls("host").alias("host")).alias(name)).distinct(), "rejected")
    rows = docs.withColumn(name, F.struct(nulls(id_col).alias("id"), _key(text_col).alias("key"), nulls(host_col).alias("host")))
    return join_ids(rows, go, name, "left_anti").drop(name)
