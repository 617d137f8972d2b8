"""Prefix trie of conversations: one row per distinct sequence of first turns, with counts over its subtree.

1. Turns become (digest of role and text, code points of text) before anything is shuffled; conversations are gathered on
   conv_id, and each turn gets the chained digest of the turns up to it, which names its node.
2. Equal conversations become one sequence with its smallest conv_id, their number and the digest of their ids.
3. Sequences are hash-partitioned by their first turn. Subtries that hold more turns than an average partition are
   repartitioned by the next turn, again and again (1, 2, 4 ... turns at a time), until each fits: `cut` is the depth of
   a sequence's subtrie. What lies above the cuts, with the root, is the spine.
4. `subtries` builds pointer dictionary tries of a partition's subtries in applyInPandas and sums them in postorder.
5. The spine is summed from its own nodes and the tops below it. A node belongs to its smallest conversation, whose nodes
   are the lower end of one path; so a path's sums run up it once, and one row for each node of a path is shuffled.

Work and shuffles are linear in the number of turns. No task gets a hot first turn, a hub or a group of copies whole; a
conversation of n turns is a row of n digests.

Null role or text: empty. Null turn: first. Ties in turn: by role, then text. Repeated rows: all stay, as turns. Rows with a
null conv_id: left out, as a node is named by a conversation. Empty table: no nodes. Empty texts: turns of 0 code points.
Very long texts: only their digests move. Columns beyond conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tessera.llm.graph import MAX_BROADCAST_IDS, join_ids
from tessera.llm.shared import materialise

#: Turns of distinct sequences that a task shall hold, and the least that a subtrie may hold before it is split.
TARGET_TURNS, LEAST_TURNS = 200_000, 64
#: Ids are hashed in runs of 2 ** ID_BITS, so that no row and no batch holds all ids of a large group.
ID_BITS = 9
#: Name of the root; all other nodes are named by 32 hexadecimal digits.
ROOT = ""
NO_IDS = hashlib.sha256(b"").hexdigest()

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def gather(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<key, chars>>) in order of turn; one shuffle of digests.

    Texts are shuffled only for conversations where two texts share turn and role, as their order decides there.
    """
    rows = rows.where("conv_id IS NOT NULL").select("conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32)

    def collected(rows: DataFrame, tie: Column) -> DataFrame:
        return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", tie.alias("tie"), key.alias("key"), F.length("text").cast("long").alias("chars")))).alias("t"))

    lean = lambda c: c.select("conv_id", F.transform("t", lambda x: F.struct(x["key"], x["chars"])).alias("turns"))
    at = F.sequence(F.lit(0), F.size("t") - 2)
    tied = F.exists(at, lambda i: F.col("t")[i]["turn"].eqNullSafe(F.col("t")[i + 1]["turn"]) & (F.col("t")[i]["role"] == F.col("t")[i + 1]["role"]) & (F.col("t")[i]["key"] != F.col("t")[i + 1]["key"]))
    first = materialise(collected(rows, F.lit("")).withColumn("tied", F.when(F.size("t") > 1, tied).otherwise(False)), "turns")
    ids = first.where("tied").select("conv_id")
    if not ids.limit(1).count():
        return lean(first)
    return lean(first.where("NOT tied")).unionByName(lean(collected(join_ids(rows, ids, "conv_id", "left_semi"), F.col("text"))))


def rebuild(turned: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversation c with its first h turns replaced by those of conversation c - c % group; h = crc32(c) % most."""
    own = materialise(turned, "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


@pandas_udf(ArrayType(StringType()))
def _prefixes(keys: pd.Series) -> pd.Series:
    """Digest of each prefix, chained from turn to turn."""

    def chain(turns):
        got, last = [], b""
        for key in turns:
            last = hashlib.blake2b(last + key.encode(), digest_size=16).digest()
            got.append(last.hex())
        return got

    return keys.map(chain)


def _hashed_ids(batches):
    """Rows (seq, run, ids, conv_id, n) of a partition sorted by seq and run -> a row per seq; ids are hashed as they come."""
    seq, state, low, count = None, None, 0, 0
    for batch in batches:
        out = []
        for s, ids, conv, n in zip(batch["seq"], batch["ids"], batch["conv_id"], batch["n"]):
            if s != seq:
                if seq is not None:
                    out.append((seq, low, count, state.hexdigest()))
                seq, state, low, count = s, hashlib.sha256(ids.encode()), conv, n
            else:
                state.update(b"," + ids.encode())
                count += n
        yield pd.DataFrame(out, columns=["seq", "conv_id", "n", "ends"])
    if seq is not None:
        yield pd.DataFrame([(seq, low, count, state.hexdigest())], columns=["seq", "conv_id", "n", "ends"])


def sequences(turned: DataFrame) -> DataFrame:
    """Distinct sequences: seq, conv_id (smallest), n, ends (digest of all its ids), prefixes, chars."""
    named = materialise(turned.select("conv_id", _prefixes(F.transform("turns", lambda t: t["key"])).alias("prefixes"), F.transform("turns", lambda t: t["chars"]).alias("chars")), "prefixes")
    seq = F.coalesce(F.try_element_at("prefixes", F.lit(-1)), F.lit(ROOT))
    runs = named.groupBy(seq.alias("seq"), F.shiftright("conv_id", ID_BITS).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select("seq", "run", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.col("ids")[0].alias("conv_id"), F.size("ids").cast("long").alias("n"))
    runs = runs.repartition("seq").sortWithinPartitions("seq", "run").mapInPandas(_hashed_ids, "seq string, conv_id long, n long, ends string")
    return materialise(runs.join(named, "conv_id"), "sequences")


def cuts(seqs: DataFrame, limit: int) -> DataFrame:
    """(seq, cut): depth of the first node on the sequence's path whose subtrie holds at most `limit` turns.

    One more than the sequence has turns where there is none: it ends on the spine.
    """
    todo, done, step = seqs.select("seq", "prefixes", F.lit(0).alias("at")), [], 1
    while True:
        length = F.size("prefixes")
        look = todo.select("seq", F.posexplode(F.slice("prefixes", F.col("at") + 1, step)).alias("i", "p"), (length - F.col("at")).alias("rest"))
        large = materialise(look.groupBy("p").agg(F.sum(F.col("rest") - F.col("i")).alias("w")).where(F.col("w") > limit).select("p"), "large")
        hits = materialise(join_ids(look.select("seq", "p"), large, "p", "left_semi").groupBy("seq").agg(F.count("*").cast("int").alias("k")), "hits")
        few = hits.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
        todo = todo.join(F.broadcast(hits) if few else hits, "seq", "left").withColumn("k", F.coalesce("k", F.lit(0)))
        on = (F.col("k") == step) & (F.col("at") + step < length)
        done.append(todo.where(~on).select("seq", (F.col("at") + F.col("k") + 1).alias("cut")))
        todo = materialise(todo.where(on).select("seq", "prefixes", (F.col("at") + step).alias("at")), "open")
        if not todo.limit(1).count():
            break
        step *= 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def subtries(part: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a partition's subtries from rows (cut, above, keys, chars, conv_id, n, ends)."""
    tops, kids, back, depth, chars, conv, n, ends, above = {}, [], [], [], [], [], [], [], []
    for cut, over, keys, sizes, c, m, e in zip(part["cut"], part["above"], part["keys"], part["chars"], part["conv_id"], part["n"], part["ends"]):
        here, at = tops, -1
        for i, key in enumerate(keys):
            node = here.get(key)
            if node is None:
                node = here[key] = len(kids)
                kids.append({}), back.append(at), depth.append(cut + i), chars.append(sizes[i])
                conv.append(c), n.append(0), ends.append(NO_IDS), above.append(over if at < 0 else None)
            conv[node], n[node] = min(conv[node], c), n[node] + m
            here, at = kids[node], node
        ends[at] = e
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for top in tops.values():  # postorder with a stack of our own: conversations may be longer than Python's stack
        stack = [(top, iter(kids[top].values()))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(kids[child].values())))
                continue
            stack.pop()
            leaves[node] += not kids[node]
            saved[node] += (n[node] - 1) * chars[node]
            if stack:
                leaves[back[node]] += leaves[node]
                saved[back[node]] += saved[node]
    parents = pd.array([conv[b] if b >= 0 else None for b in back], dtype="Int64")
    return pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": parents, "n_convs": n, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "above": above})


@pandas_udf(ArrayType(StructType().add("p", StringType()).add("leaves", LongType()).add("saved", LongType())))
def _sums_up(nodes: pd.Series, prefixes: pd.Series) -> pd.Series:
    """For each node from the root to the last of `nodes` (a path's own lower end): the sums of the own nodes at or below it."""

    def sums(own, path):
        got, leaves, saved = [], 0, 0
        own = {x["depth"]: x for x in own}
        for d in range(max(own), -1, -1):
            if d in own:
                leaves, saved = leaves + int(own[d]["leaves"]), saved + int(own[d]["saved"])
            got.append({"p": path[d - 1] if d else ROOT, "leaves": leaves, "saved": saved})
        return got

    return pd.Series([sums(o, p) for o, p in zip(nodes, prefixes)], dtype=object)


def _spine(seqs: DataFrame) -> DataFrame:
    """Nodes above the cuts: p, above, depth, chars, conv_id, n, ends."""
    path = F.slice(F.arrays_zip("prefixes", "chars"), 1, F.col("cut") - 1)
    long = seqs.where("cut > 1").select("conv_id", "n", "prefixes", F.posexplode(path).alias("i", "x"))
    over = F.when(F.col("i") > 0, F.col("prefixes")[F.greatest(F.col("i") - 1, F.lit(0))]).otherwise(ROOT)
    long = long.select("conv_id", "n", F.col("x.prefixes").alias("p"), over.alias("above"), (F.col("i") + 1).cast("long").alias("depth"), F.col("x.chars").alias("chars"))
    root = seqs.select("conv_id", "n", F.lit(ROOT).alias("p"), F.lit(None).cast("string").alias("above"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"))
    nodes = long.unionByName(root).groupBy("p", "above", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    ends = seqs.where(F.col("cut") > F.size("prefixes")).select(F.col("seq").alias("p"), "ends")
    return materialise(nodes.join(ends, "p", "left"), "spine")


def build(turned: DataFrame) -> DataFrame:
    """Nodes (NODES) of the trie of conversations (conv_id, turns), one row per conv_id."""
    spark = turned.sparkSession
    seqs = sequences(turned)
    turns = seqs.agg(F.sum(F.size("prefixes"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / TARGET_TURNS))
    seqs = materialise(seqs.join(cuts(seqs, max(LEAST_TURNS, turns // parts)), "seq"), "cut")
    cut = F.col("cut")
    work = seqs.where(cut <= F.size("prefixes")).select(
        F.pmod(F.xxhash64(F.col("prefixes")[cut - 1]), F.lit(parts)).alias("part"), "cut", F.when(cut > 1, F.col("prefixes")[F.greatest(cut - 2, F.lit(0))]).otherwise(ROOT).alias("above"),
        F.slice("prefixes", cut, F.size("prefixes")).alias("keys"), F.slice("chars", cut, F.size("prefixes")).alias("chars"), "conv_id", "n", "ends",
    )
    below = materialise(work.repartition(parts, "part").groupBy("part").applyInPandas(subtries, f"{NODES}, above string"), "subtries")
    spine = _spine(seqs)
    tops = below.where("above IS NOT NULL").groupBy(F.col("above").alias("p")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = spine.where("above IS NOT NULL").groupBy(F.col("above").alias("p")).agg(F.count("*").alias("inner"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = spine.join(tops, "p", "left").join(inner, "p", "left").withColumn("n_children", zero("tops") + zero("inner"))
    local = local.withColumn("leaves", zero("leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", zero("saved") + (F.col("n") - 1) * F.col("chars"))
    local = materialise(local, "local")
    own = local.groupBy("conv_id").agg(F.collect_list(F.struct("depth", "leaves", "saved")).alias("nodes"))
    up = own.join(seqs.select("conv_id", "prefixes"), "conv_id").select(F.explode(_sums_up("nodes", "prefixes")).alias("x")).select("x.*")
    sums = up.groupBy("p").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    named = spine.select(F.col("p").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    columns = [c.split()[0] for c in NODES.split(", ")]
    upper = local.select("p", "above", "conv_id", "depth", F.col("n").alias("n_convs"), "n_children", F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))
    upper = upper.join(sums, "p").join(named, "above", "left").select(columns)
    lower = below.where("above IS NOT NULL").drop("parent_conv_id")
    lower = join_ids(lower, named, "above", "inner").select(columns).unionByName(below.where("above IS NULL").select(columns))
    return lower.unionByName(upper)
