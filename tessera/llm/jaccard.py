r"""N-gram Jaccard join by vertical partitioning, and near-duplicate groups from its links.

A document's set is its distinct shingles: windows of `width` words (runs of [^\x20\x09-\x0D], A-Z in lower case); with
fewer words the whole sequence is one shingle; without words the set is empty and linked with nothing. Two documents
link when 100 * intersection >= percent * union.

1. Documents with one set are one class; the smallest id stands for it.
2. Shingles have a global order: rare before frequent, then by hash. Two sets that link share a shingle among the first
   n - ceil(percent * n / 100) + 1 of each, so only those are shuffled, and only shingles of two classes or more stay.
   The counts behind "frequent" steer the order alone; any order gives the same links. Frequent shingles are dealt out
   by a salt, so that no task holds all rows of one.
3. Candidates are pairs of such a shingle's classes whose sizes, and places of the shingle, allow a link. Of a set's
   first shingles those that no other class has among its own tell sets apart for certain, so their number refutes
   most chance pairs at once.
4. What is left is set against the signatures of both sets: the parity of a set's shingles in about two buckets for
   each of them. Two signatures differ in no more buckets than the sets differ in shingles, so no link is lost.
5. Each candidate is decided by vertical partitioning: the global order is cut into FRAGMENTS of about one size, each
   set into its segments, partial overlaps are counted for each fragment on its own, and summed per pair.

What is wanted is components, so candidates come in three rounds. First each class meets the smallest class of each of
its shingles; then, where a shingle still has several components, one pseudo-random class of another; last, all pairs
of different components that share a shingle. A large group of near copies is thereby linked with about as many
comparisons as members, and the last round still looks at every pair that could join two components. Pairs of one
component are not compared further, so the result holds components and not the number of links.

Null text: empty. Repeated rows: one document. Rows of one id with different texts: find_groups treats them as one
document; drop_near_copies tells them apart. Null id: a document that links with nothing. Ties: none matter, as
components are labelled by their smallest id. Empty table: empty result. Only the id and text columns are read.
Shingles are 64-bit hashes, sets are told apart by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.expr import let
from tessera.llm.graph import components, join_ids
from tessera.llm.shared import fresh_name, materialise, release
from tessera.llm.words import mix, pieces, runs, shingle_sets

FRAGMENTS = 8
#: Shingles to each 64 buckets of a signature.
SHINGLES_PER_WORD = 32
#: Sets up to this size carry a signature of at most SHORT_WORDS words into the join of all pairs.
SHORT_SET, SHORT_WORDS = 1000, 8
#: Tasks that a frequent shingle's rows are dealt to.
SALTS = 64
#: Pairs of one class that one task compares.
HUB_PAIRS = 4000
#: Shingles above the limit from which 32 bits of each are proof enough.
SLACK = 3
#: Shingles known as frequent: the most frequent of those that many documents of one task hold. They only steer.
MAX_FREQUENT, MANY = 100_000, 8


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def per_text(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums, modulo 2 ** 64, of the values from each cut to the next."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[cut])


def signatures(text: np.ndarray, mixed: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """Signatures of texts with so many shingles; mixed: a hash of each shingle of each text.

    A signature has a power of two of 64-bit words; the XOR of its halves is the signature with half the buckets.
    """
    words = np.int64(1) << np.ceil(np.log2(np.maximum(1, size / SHINGLES_PER_WORD))).astype(np.int64)
    at = np.append(0, np.cumsum(words))
    out = np.zeros(at[-1], np.uint64)
    bucket = mixed & (words[text].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    np.bitwise_xor.at(out, at[text] + (bucket >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bucket & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out.view(np.int64)))


def differing(x: Column, y: Column) -> Column:
    """In how many buckets two signatures differ; the longer one is folded first."""
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    place = lambda i, n: F.sequence(i, n - 1)

    def against(s: Column, l: Column) -> Column:  # noqa: E741
        folded = lambda w, i: F.aggregate(place(F.lit(0), (F.size(l) / F.size(s)).cast("int")), w, lambda acc, k: acc.bitwiseXOR(F.get(l, i + k * F.size(s))))
        words = F.when(F.size(s) == F.size(l), F.zip_with(s, l, lambda p, q: p.bitwiseXOR(q))).otherwise(F.transform(s, folded))
        return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))

    return let(short, lambda s: let(long, lambda l: against(s, l)))


def _differ_allows(percent: int) -> Column:
    """Whether sets of nx and ny shingles with the signatures sx and sy can link."""
    return (100 + percent) * differing(F.col("sx"), F.col("sy")) <= (100 - percent) * (F.col("nx") + F.col("ny"))


def shortened(signature: Column) -> Column:
    """The signature with SHORT_WORDS words at most."""
    more = lambda i: F.sequence(i + SHORT_WORDS, F.size(signature) - 1, F.lit(SHORT_WORDS))
    words = F.transform(F.slice(signature, 1, SHORT_WORDS), lambda w, i: F.aggregate(more(i), w, lambda acc, k: acc.bitwiseXOR(F.get(signature, k))))
    return F.when(F.size(signature) <= SHORT_WORDS, signature).otherwise(words)


def refute(seen: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y), materialised, that signatures allow to link."""
    ids = materialise(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "ids")
    signed = join_ids(seen.where("kind = 0"), ids, "id", "left_semi").select("id", "n", "signature")
    x, y = (signed.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.col("signature").alias("s" + c)) for c in "xy")
    got = materialise(pairs.join(x, "x").join(y, "y").where(_differ_allows(percent)).select("x", "y").distinct(), "pairs")
    release(ids)
    return got


def scan(docs: DataFrame, width: int) -> DataFrame:
    """Of docs (id, text): rows of kind 0 (id, n, a, b: the set's 128 bits, signature), and of kind 1 (a: shingle, n: documents).

    The second kind is what a task has seen often; a task keeps and returns a bounded number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, counts = ["kind", "id", "n", "a", "b", "signature"], [], []
        for batch in batches:
            for a, b, data, at in pieces(batch.column("text")):
                text, h = shingle_sets(data, at, width)
                mixed = mix(h)
                cut = np.searchsorted(text, np.arange(b - a + 1))
                one, two = (per_text(x, cut).view(np.int64) for x in (mixed, mix(h ^ np.uint64(0x5851F42D4C957F2D))))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b - a, np.int32)), batch.column("id").slice(a, b - a), pa.array(np.diff(cut)), pa.array(one), pa.array(two), signatures(text, mixed, np.diff(cut))], names)
                key, n = np.unique(h, return_counts=True)
                keys.append(key[n > 1])
                counts.append(n[n > 1])
                if sum(map(len, keys)) > 6 * MAX_FREQUENT:
                    key, n = _merged(keys, counts)
                    top = np.argsort(-n, kind="stable")[:MAX_FREQUENT]
                    keys, counts = [key[top]], [n[top]]
        if keys:
            key, n = _merged(keys, counts)
            top = np.argsort(-n, kind="stable")[:MAX_FREQUENT]
            top = top[n[top] >= MANY]
            none = lambda kind: pa.nulls(len(top), kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(top), np.int32)), none(pa.int64()), pa.array(n[top]), pa.array(key[top].view(np.int64)), none(pa.int64()), none(pa.list_(pa.int64()))], names)

    return materialise(docs.select(F.col("id").cast("long"), "text").mapInArrow(run, "kind int, id long, n long, a long, b long, signature array<long>"), "sets")


class Order:
    """The global order of shingles, broadcast: rare ones by hash, then the known frequent ones by how often they occur."""

    def __init__(self, often: np.ndarray, weight: np.ndarray):
        """often: sorted shingles; weight: documents of each."""
        self.often = often
        rank = np.empty(len(often), np.uint64)
        rank[np.lexsort((often, weight))] = np.arange(len(often))
        self.key = np.uint64(1 << 63) + rank

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the order, whether it is a frequent one) of each shingle."""
        key, hot = h >> np.uint64(1), np.zeros(len(h), bool)
        if len(self.often):
            spot = np.minimum(np.searchsorted(self.often, h), len(self.often) - 1)
            hot = self.often[spot] == h
            key[hot] = self.key[spot[hot]]
        return key, hot

    def fragment(self, h: np.ndarray) -> np.ndarray:
        """Which of FRAGMENTS cuts of the order a shingle lies in: the frequent ones are the last, the rare ones fill the others evenly."""
        key, hot = self(h)
        part = ((key >> np.uint64(31)) * np.uint64(FRAGMENTS - 1) >> np.uint64(32)).astype(np.int32)
        return np.where(hot, FRAGMENTS - 1, part).astype(np.int32)


def prefixes(docs: DataFrame, width: int, percent: int, order: Broadcast) -> DataFrame:
    """(shingle, salt, id, n, place): the first shingles of each set in the global order; salt is not 0 for frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in pieces(batch.column("text")):
                text, h = shingle_sets(data, at, width)
                key, hot = order.value(h)
                by = np.lexsort((key, text))
                cut = np.searchsorted(text, np.arange(b - a + 1))
                n = np.diff(cut)
                place = runs(n)
                first = place < np.repeat(n + (-percent * n) // 100 + 1, n)
                own = np.repeat(np.arange(b - a), n)[first]
                ids = batch.column("id").slice(a, b - a).take(pa.array(own))
                top = by[first]
                salt = np.where(hot[top], 1 + (mix(own.astype(np.uint64) + h[top]) % np.uint64(SALTS)).astype(np.int32), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[top].view(np.int64)), pa.array(salt), ids, pa.array(n[own].astype(np.int32)), pa.array(place[first].astype(np.int32))], ["shingle", "salt", "id", "n", "place"])

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(run, "shingle long, salt int, id long, n int, place int")


def segments(docs: DataFrame, width: int, order: Broadcast, wide: bool) -> DataFrame:
    """(id, n, fragment, segment): each set cut at the fragments of the order; empty segments are left out.

    A segment is sorted and holds whole hashes, or, if not wide, 32 bits of each.
    """
    kind = pa.int64() if wide else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in pieces(batch.column("text")):
                text, h = shingle_sets(data, at, width)
                n = np.bincount(text, minlength=b - a)
                part = order.value.fragment(h)
                values = h if wide else h.astype(np.uint32)
                by = np.lexsort((values, part, text))
                text, part, values = text[by], part[by], values[by]
                cut = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (part[1:] != part[:-1]))) if len(h) else np.zeros(0, np.int64)
                ids = batch.column("id").slice(a, b - a).take(pa.array(text[cut]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(h)).astype(np.int32)), pa.array(values.view(np.int64 if wide else np.int32), kind))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[text[cut]].astype(np.int32)), pa.array(part[cut]), lists], ["id", "n", "fragment", "segment"])

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(run, f"id long, n int, fragment int, segment array<{'long' if wide else 'int'}>")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, nx, ny, fragment, part): rows come by (x, salt, fragment), x's own segment first."""
    key, hub, nx = None, np.zeros(0, np.uint64), 0
    for batch in batches:
        x, salt, fragment, own, ids, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "salt", "fragment", "own", "id", "n"))
        at, values = batch.column("segment").offsets.to_numpy(), batch.column("segment").values.to_numpy()
        values = values.view(np.uint64 if values.dtype == np.int64 else np.uint32)
        rows, parts, sizes = [], [], []
        for i in range(len(x)):
            segment = values[at[i] : at[i + 1]]
            if own[i]:
                key, hub, nx = (x[i], salt[i], fragment[i]), segment.copy(), n[i]
            elif key == (x[i], salt[i], fragment[i]):
                part = np.count_nonzero(hub[np.minimum(np.searchsorted(hub, segment), len(hub) - 1)] == segment)
                if part:
                    rows.append(i)
                    parts.append(part)
                    sizes.append(nx)
        r = np.array(rows, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[r]), pa.array(ids[r]), pa.array(sizes, pa.int32()), pa.array(n[r]), pa.array(fragment[r]), pa.array(parts, pa.int32())], ["x", "y", "nx", "ny", "fragment", "part"])


def count_overlaps(docs: DataFrame, pairs: DataFrame, width: int, order: Broadcast, wide: bool) -> DataFrame:
    """(x, y, nx, ny, both) of the pairs (x, y): partial overlaps are counted in each fragment and summed per pair.

    Segments travel once for each pair, to (x, fragment); an x of many pairs is dealt out further by a salt.
    """
    many = pairs.groupBy("x").agg((F.count("*") / HUB_PAIRS + 1).cast("int").alias("salts"))
    members = pairs.join(many, "x").select(F.col("y").alias("id"), "x", F.pmod(F.xxhash64("y"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("own"))
    hubs = many.select(F.col("x").alias("id"), "x", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("own"))
    wants = materialise(members.unionByName(hubs), "wants")
    ids = materialise(wants.select("id").distinct(), "ids")
    parts = join_ids(segments(join_ids(docs, ids, "id", "left_semi"), width, order, wide), wants, "id", "inner")
    dealt = parts.repartition("x", "salt", "fragment").sortWithinPartitions("x", "salt", "fragment", F.desc("own"))
    met = dealt.select("x", "salt", "fragment", "own", "id", "n", "segment").mapInArrow(_overlaps, "x long, y long, nx int, ny int, fragment int, part int")
    # rows that repeat an id repeat its segments: the largest stands for them
    once = met.groupBy("x", "y", "fragment").agg(F.max("part").alias("part"), F.max("nx").alias("nx"), F.max("ny").alias("ny"))
    got = materialise(once.groupBy("x", "y").agg(F.sum("part").alias("both"), F.max("nx").alias("nx"), F.max("ny").alias("ny")), "overlaps")
    release(wants, ids)
    return got


def verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int, order: Broadcast) -> DataFrame:
    """The links (a, b) among the pairs (x, y).

    Overlaps of 32-bit segments are never too small, so what they refute is no link; what exceeds the limit by no more
    than the false equalities that sets of those sizes may show is counted again with whole hashes.
    """
    over = lambda extra: (100 + percent) * (F.col("both") - extra) >= percent * (F.col("nx") + F.col("ny"))
    link = lambda rows: rows.select(F.col("x").alias("a"), F.col("y").alias("b"))
    # sets of nx and ny shingles have about nx * ny / 2 ** 35 false equalities: sixteen times that, and SLACK
    slack = SLACK + F.col("nx").cast("double") * F.col("ny") / float(1 << 31)
    near = count_overlaps(docs, pairs, width, order, False)
    linked = near.where(over(0)).withColumn("sure", over(slack))
    close = linked.where("NOT sure").select("x", "y")
    if not close.limit(1).count():
        return link(linked)
    again = count_overlaps(docs, close, width, order, True)
    return link(linked.where("sure")).unionByName(link(again.where(over(0))))


def _sizes_allow(nx: Column, ny: Column, percent: int) -> Column:
    return 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)


def _places_allow(nx: Column, ny: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of nx and ny shingles that share those at places i and j can share enough."""
    most = F.least(i, j) + 1 + F.least(nx - 1 - i, ny - 1 - j)
    return (100 + percent) * most >= percent * (nx + ny)


def _prefix_allows(percent: int) -> Column:
    """Whether sets can link of whose first shingles `c` are shared, the last at places i and j.

    Up to the end of the shorter prefix (by the order) both sets are known: it holds all of one prefix, at least the
    places up to the last shared shingle of the other, and no more than c shingles of both.
    """
    prefix = lambda n: F.col(n) - F.ceil(percent * F.col(n) / 100) + 1
    differ = F.least(prefix("nx") + F.col("j") + 1, prefix("ny") + F.col("i") + 1) - 2 * F.col("c")
    return (100 + percent) * differ <= (100 - percent) * (F.col("nx") + F.col("ny"))


def _gaps_allow(percent: int) -> Column:
    """Whether sets can link that share a shingle after `gone` shingles of theirs that no other class has (`lone` in all).

    Such a shingle, when it stands before the end of both prefixes, is in one of the two sets alone: what the set whose
    prefix ends first has in all, and what the other has before the shared one.
    """
    differ = F.least(F.col("lonex") + F.col("goney"), F.col("loney") + F.col("gonex"))
    return (100 + percent) * differ <= (100 - percent) * (F.col("nx") + F.col("ny"))


def link_classes(docs: DataFrame, seen: DataFrame, copies: DataFrame, order: Broadcast, width: int, percent: int) -> DataFrame:
    """(node, label) of all classes that link with another.

    docs (id, text), seen: what scan made of it, copies: the ids that another id stands for.
    """
    docs = join_ids(docs.where("id IS NOT NULL"), copies, "id", "left_anti")
    found = prefixes(docs, width, percent, order)
    several, own = Window.partitionBy("shingle", "salt"), Window.partitionBy("id").orderBy("place", "shingle")
    found = found.withColumn("low", F.min("id").over(several)).withColumn("high", F.max("id").over(several)).where("salt > 0 OR low <> high")
    kept = materialise(found.select("shingle", (F.col("salt") > 0).alias("hot"), "id", "n", "place"), "kept")
    prefix = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    nth, all_ = F.row_number().over(own), F.count("*").over(Window.partitionBy("id"))
    # a row that repeats an id may make these too small, never too large
    shared = kept.withColumn("gone", F.greatest(F.col("place") - nth + 1, F.lit(0)).cast("int")).withColumn("lone", F.greatest(prefix - all_, F.lit(0)).cast("int"))
    shared = materialise(shared, "shared")
    release(kept)

    mine = ["n", "place", "gone", "lone"]
    me = F.struct("id", *mine)
    side = lambda rows, c, *more: rows.select("shingle", F.col("id").alias(c), *[F.col(k).alias(k + c) for k in mine], *more)
    met_one = lambda rows, m: side(rows.withColumn("m", m), "y", F.col("m.id").alias("x"), *[F.col(f"m.{k}").alias(k + "x") for k in mine])
    allow = _sizes_allow(F.col("nx"), F.col("ny"), percent) & _places_allow(F.col("nx"), F.col("ny"), F.col("placex"), F.col("placey"), percent) & _gaps_allow(percent)

    def over_shingle(rows: DataFrame, **what: Column) -> DataFrame:
        """rows with aggregates of each shingle; those of frequent ones, MAX_FREQUENT at most, are merged in each task and broadcast."""
        rare, hot = rows.where("NOT hot"), rows.where("hot")
        rare = rare.withColumns({k: v.over(Window.partitionBy("shingle")) for k, v in what.items()})
        few = hot.groupBy("shingle").agg(*[v.alias(k) for k, v in what.items()])
        return rare.unionByName(hot.join(F.broadcast(few), "shingle").select(rare.columns))

    def checked(pairs: DataFrame) -> DataFrame:
        """Links among the pairs that their shared shingles allow."""
        pairs = materialise(pairs.select("x", "y"), "pairs")
        left = refute(seen, pairs, percent)
        links = verify(docs, left, width, percent, order)
        release(pairs, left)
        return links

    # a pair goes if one of the shingles that it shares refutes it
    allowed = lambda met: met.groupBy("x", "y").agg(F.min(allow.cast("int")).alias("good")).where("good = 1")

    def labelled(rows: DataFrame, links: list[DataFrame]) -> DataFrame:
        """Shingles that still have several components, with the component of each class, and a class of the smallest."""
        label = components(reduce(DataFrame.unionByName, links))
        now = rows.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        now = over_shingle(now, low=F.min("label"), high=F.max("label"), m=F.min_by(me, F.struct("label", F.xxhash64("id", "shingle"))))
        return now.where("low <> high")

    star = over_shingle(shared, m=F.min_by(me, F.col("id"))).where("id <> m.id")
    links = [checked(allowed(met_one(star, F.col("m"))))]
    # a class of the smallest component, another one for each shingle, meets the classes of the others
    links.append(checked(allowed(met_one(labelled(shared, links).where("label <> low"), F.col("m")))))
    # pairs of different components: a shingle that two such classes share has several components; documents that resemble a
    # large group without linking to it would meet all its members, so signatures are part of the join, and of two classes that
    # share a shingle after many that are theirs alone (see _gaps_allow: one must be light) no pair is formed at all
    signed = seen.where(f"kind = 0 AND n <= {SHORT_SET}").select("id", shortened(F.col("signature")).alias("signature"))
    light = 2 * percent * F.least("gone", "lone") <= (100 - percent) * F.col("n")
    now = labelled(shared.join(signed, "id", "left"), links).select("shingle", "id", *mine, "label", "signature").withColumn("light", light)
    now = materialise(now, "open")
    a, b = (side(rows, c, F.col("label").alias("l" + c), F.col("signature").alias("s" + c), F.col("light").alias("light" + c)) for rows, c in ((now.where("light"), "x"), (now, "y")))
    near = F.when(F.col("sx").isNull() | F.col("sy").isNull(), F.lit(True)).otherwise(_differ_allows(percent))
    met = a.join(b, "shingle").where((F.col("lx") < F.col("ly")) | (~F.col("lighty") & (F.col("lx") > F.col("ly")))).where(allow & near)
    # the class of the smaller component is x, so that all that a pair shares is counted together
    turned = F.col("lx") > F.col("ly")
    one = lambda c, other: F.when(turned, F.col(other)).otherwise(F.col(c))
    met = met.select(*[one(c + k, c + other).alias(c + k) for c in ("n", "place") for k, other in ("xy", "yx")], one("x", "y").alias("p"), one("y", "x").alias("q"))
    whole = met.groupBy(F.col("p").alias("x"), F.col("q").alias("y")).agg(F.count("*").alias("c"), F.max("placex").alias("i"), F.max("placey").alias("j"), F.max("nx").alias("nx"), F.max("ny").alias("ny"))
    links.append(checked(whole.where(_prefix_allows(percent))))
    release(now, shared)
    return components(reduce(DataFrame.unionByName, links))


def _groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of docs (id, text) a row each: id, n, a, b (the set), component_id."""
    seen = scan(docs, width)
    top = seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(MAX_FREQUENT).toArrow()
    often, weight = top.column("a").to_numpy().view(np.uint64), top.column("n").to_numpy()
    by = np.argsort(often)
    order = docs.sparkSession.sparkContext.broadcast(Order(often[by], weight[by]))
    nodes = seen.where("kind = 0").select("id", "n", "a", "b")
    some = nodes.where("n > 0 AND id IS NOT NULL")
    # sets of several ids alone are joined back: few, and then broadcast, so that a large group of copies meets in no task
    classes = some.groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").drop("last")
    member = join_ids(some, materialise(classes, "classes"), ["n", "a", "b"], "left")
    member = materialise(member.withColumn("rep", F.coalesce("rep", "id")).select("n", "a", "b", "id", "rep"), "members")
    copies = materialise(member.where("id <> rep").select("id").distinct(), "copies")
    label = link_classes(docs, seen, copies, order, width, percent)
    out = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", "a", "b", F.coalesce("label", "rep").alias("component_id"))
    return out.unionByName(nodes.where("n = 0 OR id IS NULL").select("*", F.col("id").alias("component_id")))


def find_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    return _groups(_sets(docs, id_col, text_col), width, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which one document of each group stays: that with the smallest id, once.

    Rows of one id and one text are one document. Where an id has several texts, each is a document, ordered by id and
    then by a hash of the text. Rows without an id stay.
    """
    name = fresh_name(docs)
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    rows = _sets(docs, id_col, text_col)
    keys = materialise(docs.where(F.col(id_col).isNotNull()).select(key.alias(name)).groupBy(name).agg(F.count("*").alias("n")), "keys")
    twice = keys.where("n > 1").limit(1).count()
    if keys.groupBy(f"{name}.id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # numbers in the order of the keys, kept in a table, stand in for the ids
        numbers = materialise(keys.orderBy(name).select(name, F.monotonically_increasing_id().alias("number")), "numbers")
        rows = docs.withColumn(name, key).join(numbers, name, "left").select(F.col("number").alias("id"), F.col(text_col).cast("string").alias("text"))
        go = materialise(_groups(rows, width, percent).where("id <> component_id").select(F.col("id").alias("number")).distinct().join(numbers, "number").select(name), "copies")
        left = join_ids(docs.withColumn(name, key), go, name, "left_anti")
    else:
        go = materialise(_groups(rows, width, percent).where("id <> component_id").select(F.col("id").alias(name)).distinct(), "copies")
        left = join_ids(docs.withColumn(name, F.col(id_col).cast("long")), go, name, "left_anti")
    if twice:
        left = left.withColumn(name, key)
        left = left.where(F.col(id_col).isNotNull()).dropDuplicates([name]).unionByName(left.where(F.col(id_col).isNull()))
    return left.drop(name)
