"""Connected components and id joins over DataFrames, without collecting either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, release

#: Ids that a join may broadcast (counted first); beyond it the join is a shuffle.
MAX_BROADCAST_IDS = 500_000


def join_ids(rows: DataFrame, ids: DataFrame, on: str, how: str, most: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Join (left_semi, left_anti or inner) of wide rows with a materialised table of ids.

    The ids are counted. Up to `most` they are broadcast and the rows stay where they are; beyond, both sides are
    shuffled and the ids are hashed, so that the wide rows need no sort.
    """
    few = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), on, how)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): each node of the edges (a, b) with the smallest node that it can reach.

    Alternating large and small stars: each round is two aggregations of minima, which merge in each task first, and
    two joins. A hub's edges are split by adaptive execution like any skewed join. Ends when a round changes nothing.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = materialise(now, "edges"), None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        # edges are distinct: equal numbers and none that is new mean that nothing changed; equal hashes alone do not
        if not state[0] or (before and before[0] == state and not now.join(before[1], ["u", "v"], "left_anti").limit(1).count()):
            break
        if before:
            release(before[1])
        before = state, now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if before:
        release(before[1])
    label = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return label.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
