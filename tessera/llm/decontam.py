"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits and non-ASCII bytes, A-Z in lower case. Documents and test items meet in
shared seeds, windows of MIN_TILE words. The test words that a pair's seeds cover bound what tiles can cover, so pairs
below the threshold go no further. For the others running Karp-Rabin marks the longest non-overlapping matches again
and again until none of MIN_TILE words is left; a pair whose tiles cover enough of the test item is contamination,
in whatever order the passages stand.

The test items are held in blocks of about BLOCK_WORDS words; each block is set against all documents. One block is
answered in the scan; of several, each block's pairs are written to the shared folder and its broadcast is dropped before
the next one is made, so neither the driver nor a worker holds more than a block. Texts are not shuffled, unless an id
table beyond the broadcast bound has to be joined away.

Null or empty text: matches nothing. Items of fewer than MIN_TILE words: match nothing. Ties between matches of one
length: the first in the item, then in the document. Repeated rows: each gets its rows. Null id, of a document or an item: a row
like others, with that id. Very long texts: whole, hashed in blocks; the words of one text (about 13 bytes for each byte
of it) are held at once. Empty tables: empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import join_ids
from tessera.llm.shared import fresh_name, materialise
from tessera.llm.words import MARKS, Words, mix, pieces, runs

MIN_TILE = 4
MIN_COVER = 0.5
#: Words of test items that are broadcast at once: 8 bytes each, and about as much for their seeds.
BLOCK_WORDS = 1_000_000


class Tests:
    """Words and seeds of a block of test items."""

    def __init__(self, ids: list, texts: list[str], n: int):
        self.n, words, seeds = n, [], []
        for a, _, data, at in pieces(pa.array(texts, pa.large_string())):
            w = Words(data, at, apart=MARKS)
            h, text, first = w.shingles(n)
            words += [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(at) - 1)]
            seeds.append((h, text + a, first - w.first[text]))
        self.ids, self.words = ids, words
        h, item, place = (np.concatenate(x) if seeds else np.zeros(0, t) for x, t in zip(list(zip(*seeds)) or [(), (), ()], (np.uint64, np.int64, np.int64)))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], item[order], place[order]
        self.by_item = np.argsort(self.item, kind="stable")
        self.at_item = np.searchsorted(self.item[self.by_item], np.arange(len(ids) + 1))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.hash >> np.uint64(42)] = True

    def hits(self, text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, place in the item) of the items' seeds that a text holds, sorted; one row however often it holds them."""
        some = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        order = some[np.lexsort((h[some], text[some]))]
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])) if len(order) else np.zeros(0, bool)
        own, key = text[order[new]], h[order[new]]
        low, high = np.searchsorted(self.hash, key), np.searchsorted(self.hash, key, "right")
        seed = np.repeat(low, high - low) + runs(high - low)
        own, item, place = np.repeat(own, high - low), self.item[seed], self.place[seed]
        order = np.lexsort((place, item, own))
        return own[order], item[order], place[order]

    def seeds(self, item: int) -> np.ndarray:
        """Hashes of the item's seeds."""
        return self.hash[self.by_item[self.at_item[item] : self.at_item[item + 1]]]


def tile(test: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling with running Karp-Rabin: (place in test, place in doc, words) of each tile."""
    marked_t, marked_d, tiles = np.zeros(len(test), bool), np.zeros(len(doc), bool), []
    t, d = test.tolist(), doc.tolist()
    size = max(least, min(len(t), 64))
    base, top = 1_000_003, (1 << 61) - 1

    def windows(x: list[int], marked: np.ndarray) -> Iterator[tuple[int, int]]:
        """(rolling hash, place) of each unmarked window of `size` words."""
        lead, h, run = pow(base, size - 1, top), 0, 0
        for i, v in enumerate(x):
            if marked[i]:
                h, run = 0, 0
                continue
            if run == size:
                h = (h - x[i - size] % top * lead) % top
                run -= 1
            h, run = (h * base + v) % top, run + 1
            if run == size:
                yield h, i - size + 1

    while True:
        where = defaultdict(list)
        for h, i in windows(t, marked_t):
            where[h].append(i)
        found, longest = [], 0
        for h, j in windows(d, marked_d):
            for i in where.get(h, ()):
                if i and j and t[i - 1] == d[j - 1] and not marked_t[i - 1] and not marked_d[j - 1]:
                    continue  # part of the match that begins a word before
                k = 0
                while i + k < len(t) and j + k < len(d) and t[i + k] == d[j + k] and not marked_t[i + k] and not marked_d[j + k]:
                    k += 1
                if k >= size:
                    found.append((-k, i, j))
                    longest = max(longest, k)
        if longest > 2 * size:
            size = longest
            continue
        heapify(found)
        while found:
            k, i, j = heappop(found)
            taken = np.flatnonzero(marked_t[i : i - k] | marked_d[j : j - k])
            if not len(taken):
                marked_t[i : i - k] = marked_d[j : j - k] = True
                tiles.append((i, j, -k))
                continue
            # what longer tiles have left of the match goes back in its place
            starts, ends = np.append(0, taken + 1), np.append(taken, -k)
            for x in np.flatnonzero(ends - starts >= size):
                heappush(found, (int(starts[x] - ends[x]), int(i + starts[x]), int(j + starts[x])))
        if size <= least:
            return tiles
        size = max(least, size // 2)


def contaminated(tests: Tests, data: np.ndarray, at: np.ndarray, min_cover: float) -> list[tuple[int, int, int, int]]:
    """(text, item, tiles, words covered) of the pairs in a piece whose tiles cover at least min_cover of the item."""
    n, w = tests.n, Words(data, at, apart=MARKS)
    h, text, first = w.shingles(n)
    own, item, place = tests.hits(text, h)
    at_text = np.searchsorted(text, np.arange(len(at)))
    cuts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (item[1:] != item[:-1])) if len(own) else np.zeros(0, bool))
    gap = np.full(len(own), n)
    gap[1:] = np.minimum(n, place[1:] - place[:-1])
    gap[cuts] = n
    covered, out = np.add.reduceat(gap, cuts) if len(cuts) else [], []
    for k, a in enumerate(cuts):
        words = tests.words[item[a]]
        if covered[k] < min_cover * len(words):
            continue
        # tiles lie where seeds lie: those parts of the document, each followed by a word that occurs once
        mine = slice(at_text[own[a]], at_text[own[a] + 1])
        spots = np.unique(first[mine][np.isin(h[mine], tests.seeds(item[a]))][:, None] + np.arange(n))
        breaks = np.flatnonzero(np.diff(spots) > 1) + 1
        part = np.insert(w.hash[spots], breaks, mix(np.arange(1, len(breaks) + 1, dtype=np.uint64)))
        tiles = tile(words, part, n)
        total = sum(x[2] for x in tiles)
        if total >= min_cover * len(words):
            out.append((int(own[a]), int(item[a]), len(tiles), total))
    return out


def test_blocks(items: DataFrame, id_col: str, text_col: str, min_tile: int, block_words: int) -> tuple[int, Iterator[Tests]]:
    """(number of blocks, the test items in blocks of about block_words words, each made when it is asked for)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = items.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-total // (4 * block_words)))

    def blocks() -> Iterator[Tests]:
        for k in range(n):
            part = (rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k) if n > 1 else rows).select("id", "text").toArrow()
            if part.num_rows:
                yield Tests(part.column("id").to_pylist(), part.column("text").to_pylist(), min_tile)

    return n, blocks()


def _pairs(rows: DataFrame, kept: Broadcast, schema: str, min_cover: float) -> DataFrame:
    """The contaminated pairs of rows (id, text) with one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = kept.value
        item_type = pa.array(t.ids[:1]).type
        for batch in batches:
            for a, b, data, at in pieces(batch.column("text")):
                got = contaminated(t, data, at, min_cover)
                if got:
                    ids = batch.column("id").slice(a, b - a)
                    words = [len(t.words[x[1]]) for x in got]
                    cols = [ids.take(pa.array([x[0] for x in got])), pa.array([t.ids[x[1]] for x in got], item_type), *(pa.array(c, pa.int64()) for c in ([x[2] for x in got], [x[3] for x in got], words)), pa.array([x[3] / n for x, n in zip(got, words)])]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "item", "n_tiles", "covered", "test_words", "coverage"])

    return rows.mapInArrow(run, schema)


def find(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = MIN_TILE, min_cover: float = MIN_COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each contaminated pair: doc id, item id, n_tiles, covered (words), test_words, coverage."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, n_tiles long, covered long, test_words long, coverage double"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n, blocks = test_blocks(items, item_col, item_text_col, min_tile, block_words)
    out = docs.sparkSession.createDataFrame([], schema)
    for tests in blocks:
        kept = docs.sparkSession.sparkContext.broadcast(tests)
        part = _pairs(rows, kept, schema, min_cover)
        if n > 1:
            part = materialise(part, "contaminated")
            kept.destroy()
        out = part if n == 1 else out.unionByName(part)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tile: int = MIN_TILE, min_cover: float = MIN_COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates.

    With one block of items this is decided where the rows lie; with several, by a hash of 128 bits of the text.
    """
    n, blocks = test_blocks(items, item_col, item_text_col, min_tile, block_words)
    if n > 1:
        name, text = fresh_name(docs), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        key = F.struct(F.xxhash64(text).alias("a"), F.substring(F.md5(text), 1, 16).alias("b"))
        keyed = docs.select(key.alias(name), F.col(text_col).alias("text"))
        bad = find(keyed.select(F.to_json(name).alias("doc_id"), "text"), items, item_col=item_col, item_text_col=item_text_col, min_tile=min_tile, min_cover=min_cover, block_words=block_words)
        bad = materialise(bad.select(F.from_json("doc_id", "a long, b string").alias(name)).distinct(), "contaminated-texts")
        return join_ids(docs.withColumn(name, key), bad, name, "left_anti").drop(name)
    out = docs
    for tests in blocks:
        kept = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for a, _, data, at in pieces(batch.column(text_col).cast(pa.string())):
                    good[[a + x[0] for x in contaminated(kept.value, data, at, min_cover)]] = False
                yield batch.filter(pa.array(good))

        out = out.mapInArrow(run, docs.schema)
    return out
