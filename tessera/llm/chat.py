r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted by (turn, role, text), merged where neighbours have one
role, and concatenated:

    <turn ROLE>\nTEXT<part/>TEXT</turn>\n ...

`<part/>` stands between the texts that were merged. Inside texts each `<turn`, `</turn` and `<part/` gets a backslash
after its `<` (those that have backslashes there get one more), so no text can open, close or part a block, and reading
back takes the backslash away again. In roles `%`, `<`, `>` are percent-encoded.

Null text or role: empty. Null conv_id: a conversation of its own. Ties in turn: by role, then text; nulls first.
Repeated rows: all stay, as turns. Empty table: empty result. Other columns are not read. A conversation is one output
row, so one must fit in a row (2 GB); conversations share no task state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.expr import let

#: The template's control strings.
OPEN, OPEN_END, PART, CLOSE = "<turn ", ">\n", "<part/>", "</turn>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn|part/)", r"<\\$1$2")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn|part/)", r"<$1$2")


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape_role(role: Column) -> Column:
    return _replace(_replace(_replace(role, "%", "%25"), "<", "%3C"), ">", "%3E")


def unescape_role(role: Column) -> Column:
    return _replace(_replace(_replace(role, "%3C", "<"), "%3E", ">"), "%25", "%")


def format_conversations(rows: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, segments array<struct<text, loss>> (joined, they are formatted), n_blocks.

    A segment is under the loss mask if it is the text of a turn of loss_roles. One shuffle, on conv_id.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    last = F.size("turns") - 1
    role = lambda i: F.col("turns")[i]["role"]
    # first turn of each block of neighbours with one role, then the blocks
    got = got.withColumn("starts", F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (role(F.greatest(i - 1, F.lit(0))) != role(i))))
    n = F.size("starts")
    block = lambda b: F.struct(
        role(F.col("starts")[b]).alias("role"),
        F.transform(F.slice("turns", F.col("starts")[b] + 1, F.when(b < n - 1, F.col("starts")[F.least(b + 1, n - 1)]).otherwise(last + 1) - F.col("starts")[b]), lambda t: escape_text(t["text"])).alias("texts"),
    )
    got = got.select("conv_id", F.transform(F.sequence(F.lit(0), n - 1), block).alias("blocks"))
    plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def segments(x: Column) -> Column:
        texts = F.transform(x["texts"], lambda t, i: F.array(plain(F.when(i == 0, F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit(OPEN_END))).otherwise(F.lit(PART))), F.struct(t.alias("text"), x["role"].isin(*loss_roles).alias("loss"))))
        return F.concat(F.flatten(texts), F.array(plain(F.lit(CLOSE))))

    got = got.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), F.flatten(F.transform("blocks", segments)).alias("segments"))
    return got.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "n_blocks")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, a struct for each turn."""
    blocks = F.split(formatted, CLOSE)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(x: Column) -> Column:
        at = F.locate(OPEN_END, x)
        role = unescape_role(F.substring(x, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        texts = F.split(F.substring(x, at + len(OPEN_END), F.length(x)), PART)
        return let(role, lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescape_text(t).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from format_conversations() output: turns from the text, loss from the mask."""
    got = formatted.select("conv_id", "n_blocks", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape_text(s["text"])), "").alias("loss_text"))
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )
