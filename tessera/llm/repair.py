"""Repair of conversation structure: the cheapest edits after which the roles read (system)? (user assistant)+, or nothing.

Spark orders the rows of a conversation, finds their faults, and writes a conversation as a code with one letter a row;
`cheapest` searches the lattice (rows consumed, state of the grammar) by Dijkstra's method for each code, and Spark
applies the edits to the rows. Python sees codes alone, never texts.

Faults of a row, of which the first counts: blank (no character but white space), duplicate (role and text of an earlier row
of the conversation), truncated (the last character that is no white space is not one of . ! ?).

Edits: keep a row (0), give it role user or assistant (1), delete it (2, and the only way with a blank or duplicate row),
insert an empty row of user or assistant anywhere (5). A truncated row that stays adds 5. `audit` has the initials
D, I, K, R of the edits in order; of equally cheap edits those with the ASCII-least audit are taken.

Null role or text: one space. Null turn: first. Ties in turn: by role, then text. Repeated rows: duplicates, from the second on.
An empty role has no initial and can't be kept. Null conv_id: a conversation of its own. Empty table: empty result. Columns
beyond conv_id, turn, role and text are not read. A conversation is one output row, so it must fit in a row; the search
takes memory in proportion to its rows, and texts of any length stay in Spark.
"""

from __future__ import annotations

import functools
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar: nothing yet, after system, after user, after assistant. Edges by the initial of a row's role.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: Codes up to this length are kept with their repairs, MOST_KEPT at a time and worker: most conversations repeat one.
SHORT, MOST_KEPT = 24, 50_000

SPACE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32("conv_id:turn") % 20; nulls there and in rows: one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


class _Path:
    """An edit after a path of edits. Paths with one beginning share it; a jump back allows comparing audits in logarithmic time."""

    __slots__ = ("cost", "letter", "back", "jump", "depth", "row", "state")

    def __init__(self, cost: int, letter: str, back: _Path | None, row: int, state: int):
        self.cost, self.letter, self.back, self.row, self.state = cost, letter, back, row, state
        if back is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = back.depth + 1
            j = back.jump
            self.jump = j.jump if back.depth - j.depth == j.depth - j.jump.depth else back

    def cut(self, depth: int) -> _Path:
        x = self
        while x.depth > depth:
            x = x.jump if x.jump.depth >= depth else x.back
        return x

    def __lt__(self, other: _Path) -> bool:
        """Priority (cost, audit)."""
        if self.cost != other.cost:
            return self.cost < other.cost
        depth = min(self.depth, other.depth)
        a, b = self.cut(depth), other.cut(depth)
        if a is b:  # one audit begins the other
            return self.depth < other.depth
        while a.back is not b.back:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.back, b.back)
        return a.letter < b.letter


def _search(code: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows, one letter each: x must go; s, u, a or o (other) by role, upper case if truncated.

    No two paths to a node have one cost and one audit, or an audit that begins the other: the rows consumed fix the number of
    D, K and R, and each I costs. So the first path popped at a node is the least one, and stays least when it goes on.
    """
    heap, seen, n = [_Path(0, "", None, 0, 0)], set(), len(code)
    while heap:
        at = heapq.heappop(heap)
        if (at.row, at.state) in seen:
            continue
        if at.row == n and at.state in ENDS:
            break
        seen.add((at.row, at.state))
        edges = [("I", 0, to, INSERT) for role, to in NEXT[at.state].items() if role != "s"]
        if at.row < n:
            edges.append(("D", 1, at.state, DELETE))
            if (c := code[at.row]) != "x":
                extra = TRUNCATED if c.isupper() else 0
                if (to := NEXT[at.state].get(c.lower())) is not None:
                    edges.append(("K", 1, to, extra))
                edges += [("R", 1, to, extra + REROLE) for role, to in NEXT[at.state].items() if role != "s"]
        for letter, used, to, price in edges:
            if (at.row + used, to) not in seen:
                heapq.heappush(heap, _Path(at.cost + price, letter, at, at.row + used, to))
    cost, letters = at.cost, []
    while at.back is not None:
        letters.append(at.letter)
        at = at.back
    return cost, "".join(reversed(letters))


_kept = functools.lru_cache(MOST_KEPT)(_search)


def cheapest(code: str) -> tuple[int, str]:
    return _kept(code) if len(code) <= SHORT else _search(code)


def _plan(code: str, audit: str) -> tuple[list[int], list[str | None]]:
    """Rows of the repaired conversation: index of the source row, or -1; the new role, or None."""
    rows, roles, at, state = [], [], 0, 0
    for letter in audit:
        if letter != "D":
            if letter == "K":
                state, role = NEXT[state][code[at].lower()], None
            else:
                state, role = (3, "assistant") if state == 2 else (2, "user")
            rows.append(-1 if letter == "I" else at)
            roles.append(role)
        at += letter != "I"
    return rows, roles


@pandas_udf(StructType().add("cost", LongType()).add("audit", StringType()).add("rows", ArrayType(IntegerType())).add("roles", ArrayType(StringType())))
def _repairs(codes: pd.Series) -> pd.DataFrame:
    out = []
    for code in codes:
        cost, audit = cheapest(code)
        out.append((cost, audit, *_plan(code, audit)))
    return pd.DataFrame(out, columns=["cost", "audit", "rows", "roles"])


def _code(x: Column) -> Column:
    """A row's letter of the code."""
    initial = F.substring(x["role"], 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(x["fault"].isin("blank", "duplicate"), "x").when(x["fault"] == "truncated", F.upper(letter)).otherwise(letter)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, rows array<struct<turn, role, text, nth, fault>> in order, cost, audit, repaired array<struct<role, text>>.

    One shuffle, on conv_id: faults and conversations use its partitions.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", space("role"), space("text")).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn"))
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("nth", nth).withColumn("fault", fault)
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "nth", "fault"))).alias("rows"))
    code = F.array_join(F.transform("rows", _code), "")
    got = got.withColumn("fix", _repairs(code))

    def row(source: Column, role: Column) -> Column:
        old = F.get("rows", source)
        return F.struct(F.coalesce(role, old["role"]).alias("role"), F.coalesce(old["text"], F.lit("")).alias("text"))

    return got.select("conv_id", "rows", "fix.cost", "fix.audit", F.zip_with("fix.rows", "fix.roles", row).alias("repaired"))


def report(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """Counts and digests of repair()'s output, one row per conv_id of `rows`, also where no row is left of it."""
    turns = F.filter(F.transform("rows", lambda x: x["turn"]), lambda t: t.isNotNull())
    gaps = F.when(F.size(turns) > 0, F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns))).otherwise(0)
    count = lambda fault: F.size(F.filter("rows", lambda x: x["fault"] == fault)).cast("long").alias(fault)
    initials = F.transform("rows", lambda x: F.substring(x["role"], 1, 1))
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice(initials, 2, F.size("rows")), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal")
    text = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    got = repaired.select(F.col("conv_id").alias("id"), gaps.cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"), illegal, "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
    ids = rows.select("conv_id").distinct()
    both = ids.join(got, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    longs = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
