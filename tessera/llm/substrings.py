"""Exact substring dedup: remove every byte that a WIDTH-byte string covers which also starts earlier.

Earlier means: in a document with a smaller id, or earlier in the same document. Texts are UTF-8 bytes, matches never
cross documents, and strings are judged on the input.

1. Documents with one text are one; later ones of at least WIDTH bytes go as a whole.
2. Each WIDTH-byte window picks an anchor: its GRAM-byte string of least hash, the leftmost of equals. Equal windows
   pick the same place, so equal windows have equal anchors, and only anchors are shuffled, about one in 31 bytes. An
   anchor carries the hash of its surroundings, the span of all windows that may pick it. Anchors with an equal anchor
   and surroundings earlier are repeats with all their windows; within a batch these are told apart before the shuffle.
3. What is left of an anchor's group differs somewhere in its surroundings, as at the ends of a repeated passage. The
   right and the (reversed) left sides of those anchors are suffixes; they are sorted by hash comparisons with binary
   search (see suffixes.py, which verifies against the bytes and falls back to them), and runs of common length give,
   for each distance, the classes of equal windows; all but the earliest of a class are repeats. A group of more than
   LARGE anchors is first held, byte by byte, against its earliest anchor: windows within what the two have in common are
   repeats, and what goes beyond that meets again only with anchors that leave the earliest one at the same byte, in
   the same way. Those are smaller groups of their own, to be sorted, or to be held against their own earliest anchor.
4. Repeated windows are put together by document.

Null text: empty. Null id: compared with nothing, kept whole. Repeated rows (one id and one text): one document, each
row with its result. One id with different texts: different documents, ordered by a hash of the text. Empty table:
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.graph import join_ids
from tessera.llm.shared import materialise
from tessera.llm.suffixes import Suffixes
from tessera.llm.words import CODES, PLACE, mix, pieces, prefix_hashes, runs, span_hashes

WIDTH, GRAM = 100, 40
#: Windows worked on at once; below 2 ** 21, as places are packed into the low bits of hashes.
BLOCK = 1 << 18
_LOW = np.uint64((1 << 21) - 1)
#: Anchors whose suffixes are sorted at once.
CHUNK = 100_000
#: Groups of anchors (one string, different surroundings) above this size are cut by where they leave the earliest anchor.
LARGE = 2_000
#: Large groups whose earliest anchors may be broadcast, with 2 * WIDTH bytes each.
MOST_GROUPS = 100_000

KEY = ["id", "sub"]


def _block(data: np.ndarray, at: np.ndarray, s: int, e: int, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """pick_anchors for the windows that start in [s, e); places count from the piece's start."""
    reach = width - gram
    low, high = max(0, s - reach), min(len(data), e + reach + width)
    prefix = prefix_hashes(CODES[data[low:high]])
    spot = np.arange(s - low, e - low + reach)
    v = (mix(span_hashes(prefix, spot, spot + gram)) & ~_LOW) | np.arange(len(spot)).astype(np.uint64)
    span = 1
    while span * 2 <= reach + 1:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < reach + 1:
        v = np.minimum(v[: e - s], v[reach + 1 - span : reach + 1 - span + e - s])
    picked = (v[: e - s] & _LOW).astype(np.int64) + s
    # windows that lie in one text; a text's first and last windows border on invalid ones of the texts next to it
    first, end = np.clip(at[:-1], s, e), np.clip(at[1:] - width + 1, s, e)
    count = np.maximum(end - first, 0)
    text = np.repeat(np.arange(len(count)), count)
    window = runs(count) + np.repeat(first, count)
    place = picked[window - s]
    cut = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))) if len(place) else np.zeros(0, np.int64)
    last = np.append(cut[1:], len(place))[: len(cut)] - 1
    text, place = text[cut], place[cut]
    return text, place, place - window[last], place - window[cut], mix(span_hashes(prefix, place - low, place - low + gram) + PLACE[7])


def pick_anchors(data: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, low, high, hash, surroundings): anchors of a piece, each with the distances of its windows.

    The piece is worked on in blocks. The hash is a polynomial; the surroundings' is of another kind, so that two
    anchors with both equal are taken to be alike by 128 bits.
    """
    n, reach = len(data) - width + 1, width - gram
    got = [_block(data, at, s, min(s + BLOCK, n), width, gram) for s in range(0, n, BLOCK)]
    if not got:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    text, place, low, high, h = map(np.concatenate, zip(*got))
    # an anchor of windows of two blocks came twice
    new = np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])) if len(place) else np.zeros(0, bool)
    last = np.append(np.flatnonzero(new)[1:], len(place)) - 1 if len(place) else np.zeros(0, np.int64)
    text, place, low, high, h = text[new], place[new], low[last], high[new], h[new]
    a, b = np.maximum(place - reach, at[text]), np.minimum(place + width, at[text + 1])
    raw = data.tobytes()
    near = np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(a.tolist(), b.tolist())], np.uint64)
    return text, place - at[text], low, high, h, mix(near + (place - a).astype(np.uint64) * PLACE[5])


def anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(hash, around, id, sub, place, low, high, again) of all anchors; `again`: the batch holds the like of it earlier.

    Those known as repeats get a hash of their own, so that common passages don't meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs = (batch.column(c).to_numpy() for c in KEY)
            got = [(text + a, *rest) for a, _, data, at in pieces(batch.column("text")) for text, *rest in [pick_anchors(data, at, width, gram)]]
            if not got:
                continue
            row, place, low, high, h, around = map(np.concatenate, zip(*got))
            order = np.lexsort((place, subs[row], ids[row], around, h))
            again = np.zeros(len(h), bool)
            again[order[1:]] = (h[order][1:] == h[order][:-1]) & (around[order][1:] == around[order][:-1])
            own = mix(ids[row].view(np.uint64) * PLACE[8] + subs[row].view(np.uint64) + place.astype(np.uint64) * PLACE[9])
            cols = [np.where(again, own, h).view(np.int64), np.where(again, 0, around.view(np.int64)), ids[row], subs[row], place.astype(np.int32), low.astype(np.int32), high.astype(np.int32), again]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["hash", "around", *KEY, "place", "low", "high", "again"])

    return docs.select(*KEY, "text").mapInArrow(run, "hash long, around long, id long, sub long, place int, low int, high int, again boolean")


def sides(docs: DataFrame, ends: DataFrame, width: int, gram: int) -> DataFrame:
    """ends (hash, key, place, low, high) with the bytes around each anchor: left (reversed) and right."""
    wanted = ends.groupBy(*KEY).agg(F.collect_list(F.struct("hash", "place", "low", "high")).alias("ends"))
    touched = materialise(ends.select(*KEY).distinct(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for i, sub, text, found in zip(*(batch.column(c) for c in (*KEY, "text", "ends"))):
                raw, i, sub = text.as_py().encode(), i.as_py(), sub.as_py()
                for e in found.as_py():
                    p = e["place"]
                    for c, v in zip(cols, (e["hash"], i, sub, p, e["low"], e["high"], raw[max(0, p - width + gram) : p][::-1], raw[p : p + width])):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["hash", *KEY, "place", "low", "high", "left", "right"])

    met = join_ids(docs, touched, KEY, "left_semi").join(wanted.hint("shuffle_hash"), KEY)
    return met.select(*KEY, "text", "ends").mapInArrow(run, "hash long, id long, sub long, place int, low int, high int, left binary, right binary")


def _classes(data: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the strings by group, then suffix; common length of each with the one before)."""
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    s = Suffixes(raw[: at[-1]], at[:-1], np.diff(at))
    perm = s.sort(group)
    common = s.verified(perm, group)
    return s.by_bytes(group) if common is None else (perm, common)


def repeated_windows(group: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray, left: pa.Array, right: pa.Array, width: int, gram: int) -> np.ndarray:
    """anchors x distances: whether the window that starts so far before the anchor equals one of a smaller rank.

    group is nondecreasing; left sides are reversed.
    """
    perm_l, common_l = _classes(left, group)
    perm_r, common_r = _classes(right, group)
    n, reach = len(group), width - gram
    out = np.zeros((n, reach + 1), bool)
    new_group = np.append(True, group[1:] != group[:-1])
    class_l, class_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(max(0, int(low.min())), min(reach, int(high.max())) + 1):
        here = np.flatnonzero((low <= o) & (o <= high))
        if len(here) < 2:
            continue
        class_l[perm_l] = np.cumsum(new_group | (common_l < o))
        class_r[perm_r] = np.cumsum(new_group | (common_r < width - o))
        key = class_r[here] * (n + 1) + class_l[here]
        order = np.lexsort((rank[here], key))
        later = np.append(False, key[order][1:] == key[order][:-1])
        out[here[order[later]], o] = True
    return out


def _runs(rows: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last distance) of the runs of set flags in each row."""
    edge = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    a, b = np.nonzero(step == 1), np.nonzero(step == -1)
    return rows[a[0]], a[1], b[1] - 1


def sort_ends(ends: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, start, end): bytes of repeated windows among anchors with sides, group by group of equal anchors."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        ids, subs, place, h, low, high = (t.column(c).to_numpy() for c in (*KEY, "place", "hash", "low", "high"))
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((place, subs, ids))] = np.arange(len(ids))
        group = np.cumsum(np.append(False, h[1:] != h[:-1]))
        left, right = (t.column(c).combine_chunks() for c in ("left", "right"))
        row, a, b = _runs(np.arange(len(ids)), repeated_windows(group, rank, low, high, left, right, width, gram))
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(subs[row]), pa.array((place[row] - b).astype(np.int32)), pa.array((place[row] - a + width).astype(np.int32))], [*KEY, "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= CHUNK:
                h = held.column("hash").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last group may go on in the next batch
                if whole:
                    yield solve(held.slice(0, whole).combine_chunks())
                    held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return ends.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "id long, sub long, start int, end int")


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Of docs (key, text) with their spans array<struct<start, end>>: key, n_bytes, n_removed, n_spans, kept_sha256, kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw = text.as_py().encode()
                s = spans.values.flatten()
                a, b = s[0].to_numpy(), s[1].to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                first, end = a[new], b[np.append(new[1:], len(a)) - 1]
                kept = b"".join(raw[x:y] for x, y in zip([0, *end.tolist()], [*first.tolist(), len(raw)]))
                rows.append((len(raw), len(raw) - len(kept), len(new), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    met = docs.join(spans.hint("shuffle_hash"), KEY)
    return met.select("id", "text", "spans").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _against_first(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """Anchors with the earliest of their group -> spans that repeat it (start, end), and the anchors' other windows, regrouped."""
    out: list[list] = [[] for _ in range(10)]
    for g, i, sub, place, low, high, left, right, first in zip(*(batch.column(c).to_pylist() for c in ("hash", *KEY, "place", "low", "high", "left", "right", "first"))):
        common_l, common_r = len(os.path.commonprefix([left, first["left"]])), len(os.path.commonprefix([right, first["right"]]))
        a, b = max(low, width - common_r), min(high, common_l)
        rest = []
        if a <= b and (i, sub, place) != (first["id"], first["sub"], first["place"]):
            rest.append((None, None, None, None, None, place - b, place - a + width))
        name = lambda side, n, data, g=g: xxhash.xxh3_64_intdigest(b"%d %s %d " % (g, side, n) + data[: n + 1]) - (1 << 63)
        if common_l < high:
            rest.append((name(b"left", common_l, left), max(low, common_l + 1), high, left, right, None, None))
        if low <= (end := min(high, common_l, width - common_r - 1)):
            rest.append((name(b"right", common_r, right), low, end, left, right, None, None))
        for h, lo, hi, x, y, start, stop in rest:
            for c, v in zip(out, (h, i, sub, place, lo, hi, x, y, start, stop)):
                c.append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["hash", *KEY, "place", "low", "high", "left", "right", "start", "end"])


def cut_large(ends: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, start, end) of repeated windows among anchors with sides whose groups are too large for one task.

    If two anchors have an equal window that the earliest one has not, both leave the earliest one at the same byte of that
    window, with the same byte in its place; so they meet again in a group that is named by the side, the place and the bytes up to
    there. Groups get smaller, and what their members share gets longer, until all fit. A group's name is a hash: where two share
    it, the bytes tell them apart, here as in the sort.
    """
    rows, out = ends, None
    schema = "hash long, id long, sub long, place int, low int, high int, left binary, right binary, start int, end int"
    while True:
        first = materialise(rows.groupBy("hash").agg(F.min(F.struct(*KEY, "place", "left", "right")).alias("first")), "first")
        met = join_ids(rows, first, "hash", "inner", MOST_GROUPS)
        parts = materialise(met.mapInArrow(lambda batches: (_against_first(b, width) for b in batches), schema), "parts")
        spans = parts.where("start IS NOT NULL").select(*KEY, "start", "end")
        out = spans if out is None else out.unionByName(spans)
        rows = parts.where("start IS NULL").drop("start", "end")
        counts = rows.groupBy("hash").agg(F.count("*").alias("n"))
        large = materialise(counts.where(F.col("n") > LARGE).select("hash"), "hot")
        if not large.limit(1).count():
            return out.unionByName(sort_ends(rows, width, gram))
        out = out.unionByName(sort_ends(join_ids(rows, large, "hash", "left_anti"), width, gram))
        rows = join_ids(rows, large, "hash", "left_semi")


def find_spans(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, start, end): spans of bytes of docs (key, text) that repeat something earlier; they may overlap."""
    same, like = Window.partitionBy("hash"), Window.partitionBy("hash", "around").orderBy(*KEY, "place")
    found = anchors(docs, width, gram).withColumn("least", F.min("around").over(same)).withColumn("most", F.max("around").over(same))
    found = found.withColumn("nth", F.row_number().over(like)).withColumn("again", F.col("again") | (F.col("nth") > 1))
    found = materialise(found.where("again OR least <> most").select("hash", *KEY, "place", "low", "high", "again"), "anchors")
    whole = found.where("again").select(*KEY, (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + width).alias("end"))
    ends = found.where("NOT again").drop("again")
    hot = materialise(ends.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("hash"), "hot")
    if not hot.limit(1).count():
        return whole.unionByName(sort_ends(sides(docs, ends, width, gram), width, gram))
    usual, large = join_ids(ends, hot, "hash", "left_anti"), join_ids(ends, hot, "hash", "left_semi")
    return whole.unionByName(sort_ends(sides(docs, usual, width, gram), width, gram)).unionByName(cut_large(materialise(sides(docs, large, width, gram), "large"), width, gram))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    nodes = materialise(rows.select("id", F.xxhash64("text").alias("sub"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    twice = nodes.groupBy("id").agg(F.min("sub").alias("a"), F.max("sub").alias("b")).where("a <> b").limit(1).count()
    if not twice:
        nodes = nodes.withColumn("sub", F.lit(0).cast("long"))
    rows = rows.select("id", (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("sub"), "text")
    long = nodes.where((F.col("n_bytes") >= width) & F.col("id").isNotNull())
    # digests of several ids alone are joined back: few, and then broadcast, so that a large group of copies meets in no task
    first = materialise(long.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("sha", "first"), "firsts")
    copies = materialise(join_ids(long, first, "sha", "inner").where("id <> first").select(*KEY).distinct(), "copies")
    own = join_ids(rows.where((F.octet_length("text") >= width) & F.col("id").isNotNull()), copies, KEY, "left_anti")
    if long.groupBy(*KEY).count().where("count > 1").limit(1).count():
        own = own.dropDuplicates(KEY)
    spans = materialise(find_spans(own, width, gram).groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    touched = materialise(spans.select(*KEY), "ids")
    cut = remove(join_ids(rows, touched, KEY, "left_semi"), spans)
    whole = nodes.join(copies, KEY, "left_semi").select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    zero = F.lit(0).cast("long")
    clean = nodes.join(copies.unionByName(touched), KEY, "left_anti").select("id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return clean.unionByName(whole).unionByName(cut).withColumnRenamed("id", id_col)
