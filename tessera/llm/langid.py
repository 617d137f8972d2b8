r"""Language identification by partial matching (PPM) on bytes.

For each language a context tree of order 3 holds how often each byte followed each context of 0 to 3 bytes in the
training texts. A byte's code length under a language is that of method C: -log2(count / (total + distinct)) in the
longest context that has seen the byte, plus -log2(distinct / (total + distinct)) for each known longer context that
has not; an unknown byte costs 8 bits below order 0. Statistics are frozen before scoring, so code lengths are exact
functions of the last four bytes and are tabled for all languages at once, in units of 1 / UNIT bit.

A text gets the language with the shortest code, the first by name among equals; its score is the posterior of that
language under equal priors. `und`, score 0: null texts, texts without a letter (\p{L}), and all texts if nothing was
learned. Whole texts are scored.

Training reads only text and non-null lang of rows whose crc32(id as text) mod 4 is not 2; of each language, about
ROWS_PER_LANG rows chosen by a hash of the id, with their whole texts. All counts of that sample are kept. The model is cut by
languages into shards whose tables (4-grams by languages) have SHARD_CELLS numbers of 4 bytes; one shard is built, and one is
scored with, at a time, and what they say of a text is put together exactly, so that the cut changes no result. The score is near
1 for any text of some length, as code lengths add up: it tells short texts apart, and is no measure of confidence for
long ones. Null id: never learned from. Repeated rows: scored each. Empty table: empty result. Very long texts: in blocks. Only
the id, text and lang columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, release
from tessera.llm.words import pieces

ROWS_PER_LANG = 2000
#: Numbers in the largest table of a shard, unless one language alone has more.
SHARD_CELLS = 1 << 26
#: Languages whose shares are broadcast; the shares of more are joined by shuffle.
FEW_LANGS = 10_000
#: Bytes that are turned into 4-grams at once.
BLOCK = 1 << 18
ORDER = 3
UNIT = 1 << 12
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def grams(data: np.ndarray, at: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
    """For each byte of [start, end) it and the three before it in its text (zeros before its start), as one number."""
    end = len(data) if end is None else end
    place = np.arange(start, end) - np.repeat(at[:-1], np.diff(np.clip(at, start, end)))
    out = data[start:end].astype(np.uint32)
    for k in range(1, ORDER + 1):
        before = np.zeros(end - start, np.uint32)
        low = max(start - k, 0)
        before[low + k - start :] = data[low : end - k] if end > k else 0
        out |= np.where(place >= k, before, np.uint32(0)) << np.uint32(8 * k)
    return out


def count_grams(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_lang: int) -> DataFrame:
    """(lang, gram, n) over the training sample; counts are merged in each task before the shuffle."""
    usable = ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    labelled = docs.where(usable).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    share = labelled.groupBy("lang").agg((F.lit(float(rows_per_lang)) / F.count("*")).alias("share"))
    few = share.limit(FEW_LANGS + 1).count() <= FEW_LANGS
    chance = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    picked = labelled.select("lang", "text", chance.alias("chance")).join(F.broadcast(share) if few else share, "lang").where("chance < share").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(names)):
                part = batch.column("text").filter(pa.array(names == lang))
                for _, _, data, at in pieces(part, 1 << 22):
                    for s in range(0, len(data), 16 * BLOCK):
                        g, n = np.unique(grams(data, at, s, min(len(data), s + 16 * BLOCK)), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return picked.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """uint32 keys to row numbers by open addressing, looked up for whole arrays; -1 for none."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.key, self.row = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.row[at] < 0
            self.row[at[free]] = left[free]  # of several that want one slot the last gets it
            won = self.row[at] == left
            self.key[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.row[at]
        left = np.flatnonzero((out >= 0) & (self.key[at] != keys))
        while len(left):
            at = (at if len(at) == len(left) else at[left]) + 1 & ((1 << self.bits) - 1)
            got, want = self.row[at], keys[left]
            wrong = (got >= 0) & (self.key[at] != want)
            out[left] = got
            left, at = left[wrong], at[wrong]
        return out


class Model:
    """Code lengths of all languages, by 4-gram, 3-gram and 2-gram, and the escapes that link them."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language its 4-grams (uint32, distinct) and how often they occur."""
        self.langs = langs
        # parts are rounded before they are added, so that a table's entry equals the sum that stands for it elsewhere
        fixed = lambda x: np.round(x * UNIT).astype(np.int32)
        by_order = []
        for g, n in counts:
            orders = []
            for k in range(ORDER + 1):
                key, where = np.unique(g & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
                c = np.bincount(where, n, len(key)).astype(np.int64)
                context, where = np.unique(key >> np.uint32(8), return_inverse=True)
                # of order k the context is what stands before the byte
                total, distinct = np.bincount(where, c, len(context)), np.bincount(where, minlength=len(context))
                orders.append({"key": key, "bits": fixed(-np.log2(c / (total + distinct)[where])), "context": context, "escape": fixed(-np.log2(distinct / (total + distinct)))})
            by_order.append(orders)
        n_langs = len(langs)
        whole = lambda k: np.unique(np.concatenate([o[k]["key"] for o in by_order])) if by_order else np.zeros(0, np.uint32)
        zeros = lambda *shape: np.zeros(shape, np.int32)
        self.pair = zeros(1 << 16, n_langs)
        key3, key4 = whole(2), whole(3)
        context3 = np.unique(key4 >> np.uint32(8))
        bits3, bits4 = zeros(len(key3), n_langs), zeros(len(key4), n_langs)
        self.escape2, escape3 = zeros(1 << 16, n_langs), zeros(len(context3), n_langs)
        for j, o in enumerate(by_order):
            single = np.full(256, o[0]["escape"][0] + 8 * UNIT, np.int32)
            single[o[0]["key"]] = o[0]["bits"]
            escape1 = zeros(256)
            escape1[o[1]["context"]] = o[1]["escape"]
            pair = (escape1[:, None] + single[None, :]).ravel()
            pair[o[1]["key"]] = o[1]["bits"]
            self.escape2[o[2]["context"], j] = o[2]["escape"]
            bits3[:, j] = self.escape2[key3 >> np.uint32(8), j] + pair[key3 & np.uint32(0xFFFF)]
            bits3[np.searchsorted(key3, o[2]["key"]), j] = o[2]["bits"]
            escape3[np.searchsorted(context3, o[3]["context"]), j] = o[3]["escape"]
            bits4[:, j] = escape3[np.searchsorted(context3, key4 >> np.uint32(8)), j] + bits3[np.searchsorted(key3, key4 & np.uint32(0xFFFFFF)), j]
            bits4[np.searchsorted(key4, o[3]["key"]), j] = o[3]["bits"]
            self.pair[:, j] = pair
        self.bits3, self.bits4, self.escape3 = bits3, bits4, escape3
        self.table3, self.table4, self.contexts = Table(key3), Table(key4), Table(context3)

    def lengths(self, g: np.ndarray) -> np.ndarray:
        """Code lengths (bytes x languages) in units of 1 / UNIT bit."""
        row = self.table4.find(g)
        out = self.bits4[row] if len(self.bits4) else np.zeros((len(g), len(self.langs)), np.int32)
        new = np.flatnonzero(row < 0)
        if len(new):
            h = g[new]
            row3, context = self.table3.find(h & np.uint32(0xFFFFFF)), self.contexts.find(h >> np.uint32(8))
            bits = np.where((row3 >= 0)[:, None], self.bits3[row3], self.escape2[h >> np.uint32(8) & np.uint32(0xFFFF)] + self.pair[h & np.uint32(0xFFFF)])
            out[new] = bits + np.where((context >= 0)[:, None], self.escape3[context], 0)
        return out

    def text_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Summed code lengths (texts x languages); in blocks, so that long texts need no more memory."""
        out = np.zeros((len(at) - 1, len(self.langs)), np.int64)
        for start in range(0, len(data), BLOCK):
            end = min(start + BLOCK, len(data))
            total = np.zeros((end - start + 1, len(self.langs)), np.int64)
            np.cumsum(self.lengths(grams(data, at, start, end)), axis=0, out=total[1:])
            cut = np.clip(at - start, 0, len(total) - 1)
            out += total[cut[1:]] - total[cut[:-1]]
        return out


class Shards:
    """A model cut by languages, in order of their names; each shard is a broadcast."""

    def __init__(self, kept: list[Broadcast], n_langs: int):
        self.kept, self.n_langs = kept, n_langs

    def each(self) -> Iterator[Model]:
        """The shards one after another: of several, only one is held at a time."""
        for b in self.kept:
            yield b.value if len(self.kept) == 1 else b.load_from_path(b._path)


def cut_languages(sizes: list[tuple[str, int]], cells: int) -> list[list[str]]:
    """Languages (name, 4-grams) in order of names, cut where a table of all their 4-grams would have more cells."""
    out: list[list[str]] = []
    total = 0
    for name, n in sorted(sizes):
        if not out or (total + n) * (len(out[-1]) + 1) > cells:
            out.append([])
            total = 0
        out[-1].append(name)
        total += n
    return out


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG, shard_cells: int = SHARD_CELLS) -> Shards:
    """The frozen model of a bounded sample; the driver gathers one shard's counts at a time, and a number for each language."""
    counts = materialise(count_grams(docs, id_col, text_col, lang_col, rows_per_lang), "grams")
    sizes = [(r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    kept = []
    for langs in cut_languages(sizes, shard_cells):
        got = counts.where(F.col("lang").isin(langs)).toArrow().combine_chunks()
        lang, gram, n = (np.asarray(got.column(c).to_pylist(), object) if c == "lang" else got.column(c).to_numpy() for c in ("lang", "gram", "n"))
        order = np.argsort(gram, kind="stable")
        model = Model(langs, [(gram[order][lang[order] == x].astype(np.uint32), n[order][lang[order] == x]) for x in langs])
        kept.append(docs.sparkSession.sparkContext.broadcast(model))
    release(counts)
    return Shards(kept, len(sizes))


def predict(docs: DataFrame, model: Shards, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            # the shortest code of each text, its language, and the sum of all languages' likelihoods relative to it
            least, best, total = np.full(n, np.inf), np.full(n, "und", object), np.zeros(n)
            for m in model.each():
                names = np.array(m.langs, object)
                for a, b, data, at in pieces(batch.column("text")):
                    bits = m.text_lengths(data, at) / UNIT
                    low = bits.min(1)
                    more = np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                    old, new = least[a:b], np.minimum(least[a:b], low)
                    total[a:b] = total[a:b] * np.exp2(np.maximum(new - old, -1000)) + more * np.exp2(np.maximum(new - low, -1000))
                    best[a:b] = np.where(low < old, names[bits.argmin(1)], best[a:b])
                    least[a:b] = new
            some = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool) & (total > 0)
            rows = [batch.column(c) for c in ("id", "held_out")]
            score = np.divide(1.0, total, out=np.zeros(n), where=some)
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.where(some, best, "und"), pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
