"""Edit-aware token counts: a segment tree per document over runs of pre-tokens.

A leaf holds the text between two safe boundaries, places between a character that is no white space and a white space
after it, about LEAF characters apart. No pre-token crosses such a place or depends on what is beyond it, so a text's
token count is the sum of its leaves'. The tree keeps sums of characters and tokens. An edit finds its leaves by
position, takes a neighbour in as boundary context where it touches a leaf's edge, encodes that region anew, and
updates the sums above it. build_trees makes the leaves' figures a table, and edit_trees applies a table of edits to it, so
that a later run encodes what its edits touch and nothing else; count_tokens does both at once for documents.

Edits are applied in order to the text as it then is; positions count characters and are cut to the text's length.
Null text: empty. Null edits: none. Null id: a row like others. Repeated rows: each counted. Very long texts: whole, as a tree of
short leaves; a run without a safe boundary is one leaf, encoded at its cost. Empty table: empty result. Only the id,
text and edits columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import encode, encoding, parts

LEAF = 128


class TokenTree:
    """A binary tree over the leaves of a text: each node holds the characters and tokens under it.

    Leaves that an edit replaces become the root of a small balanced subtree, and the sums above it are updated; when
    the tree has grown too deep, or holds too many empty leaves, it is built anew, which is rare enough that an edit
    costs a logarithm on average.
    """

    def __init__(self, enc: tiktoken.Encoding, text: str, leaf: int = LEAF, stored: list[tuple[int, int]] | None = None):
        """stored: (characters, tokens) of the leaves of the text, kept from before; then nothing is encoded."""
        self.enc, self.leaf, self.encoded = enc, leaf, 0
        if stored is None:
            leaves = [(x, self._count(x)) for x in parts(text, leaf) if x]
        else:
            leaves, at = [], 0
            for n, tokens in stored:
                leaves.append((text[at : at + n], tokens))
                at += n
            if at != len(text):
                raise ValueError("the stored leaves are not of this text")
        self._fill(leaves)
        self.first_encoded, self.encoded = self.encoded, 0

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(encode(self.enc, text))

    def _fill(self, leaves: list[tuple[str, int]]) -> None:
        self.kids: list[tuple[int, int] | None] = []
        self.up: list[int] = []
        self.text: list[str] = []
        self.chars: list[int] = []
        self.tokens: list[int] = []
        self.deepest = 2 * max(1, len(leaves)).bit_length() + 8
        self.most = 4 * len(leaves) + 64
        self.root = self._subtree(leaves or [("", 0)], -1)

    def _node(self, up: int) -> int:
        for column, x in ((self.kids, None), (self.up, up), (self.text, ""), (self.chars, 0), (self.tokens, 0)):
            column.append(x)
        return len(self.up) - 1

    def _subtree(self, leaves: list[tuple[str, int]], up: int) -> int:
        """A balanced tree of the leaves (one at least)."""
        i = self._node(up)
        self._put(i, leaves)
        return i

    def _put(self, i: int, leaves: list[tuple[str, int]]) -> None:
        """Make node i the root of a balanced tree of the leaves."""
        if len(leaves) == 1:
            self.kids[i], self.text[i], self.chars[i], self.tokens[i] = None, leaves[0][0], len(leaves[0][0]), leaves[0][1]
            return
        half = len(leaves) // 2
        self.text[i] = ""
        self.kids[i] = self._subtree(leaves[:half], i), self._subtree(leaves[half:], i)
        self._sum(i)

    def _sum(self, i: int) -> None:
        a, b = self.kids[i]
        self.chars[i], self.tokens[i] = self.chars[a] + self.chars[b], self.tokens[a] + self.tokens[b]

    def _replace(self, i: int, leaves: list[tuple[str, int]]) -> None:
        self._put(i, leaves)
        while self.up[i] >= 0:
            i = self.up[i]
            self._sum(i)

    def _find(self, place: int) -> tuple[int, int, int]:
        """(leaf, where it starts, how deep) of the character at place; of the last character if place is the text's end."""
        place = min(place, max(self.chars[self.root] - 1, 0))
        i, start, depth = self.root, 0, 0
        while self.kids[i]:
            a, b = self.kids[i]
            depth += 1
            if place - start < self.chars[a] or not self.chars[b]:
                i = a
            else:
                start += self.chars[a]
                i = b
        return i, start, depth

    @property
    def n_tokens(self) -> int:
        return self.tokens[self.root]

    @property
    def n_chars(self) -> int:
        return self.chars[self.root]

    def leaves(self) -> list[tuple[str, int]]:
        """(text, tokens) of the leaves that are not empty, in order."""
        out, todo = [], [self.root]
        while todo:
            i = todo.pop()
            if self.kids[i]:
                todo += self.kids[i][::-1]
            elif self.text[i]:
                out.append((self.text[i], self.tokens[i]))
        return out

    def whole(self) -> str:
        return "".join(x for x, _ in self.leaves())

    def edit(self, place: int, delete: int, insert: str) -> None:
        place = max(0, min(place, self.n_chars))
        end = min(self.n_chars, place + max(0, delete))
        first, start, _ = self._find(place)
        # boundary context: what touches an edge of its leaves takes the next one in
        low = start - 1 if place <= start + 1 and start > 0 else place
        last, last_start, _ = self._find(max(place, end - 1))
        high = last_start + len(self.text[last])
        high = high + 1 if end >= high - 1 and high < self.n_chars else high
        touched, at, begin, deep = [], low, None, 0
        while not touched or at < high:
            i, start, depth = self._find(at)
            begin = start if begin is None else begin
            touched.append(i)
            deep, at = max(deep, depth), start + max(1, len(self.text[i]))
        region = "".join(self.text[i] for i in touched)
        region = region[: place - begin] + insert + region[end - begin :]
        new = [(x, self._count(x)) for x in parts(region, self.leaf) if x] or [("", 0)]
        for k, i in enumerate(touched):
            mine = new[k : k + 1] if k < len(touched) - 1 else new[k:]
            self._replace(i, mine or [("", 0)])
        if deep + len(new).bit_length() > self.deepest or len(self.up) > self.most:
            self._fill(self.leaves())


def standard_edits(id_col: Column, text: Column) -> Column:
    """Three edits of a text that depend on its id alone: an insertion, a deletion and a replacement."""
    spot = lambda k: F.pmod(F.xxhash64(id_col, F.lit(k)), F.length(text) + 1).cast("int")
    edit = lambda k, n, s: F.struct(spot(k).alias("place"), F.lit(n).alias("delete"), F.lit(s).alias("insert"))
    return F.array(edit(1, 0, " see note 42,"), edit(2, 7, ""), edit(3, 5, "naïve\n\n it's"))


_LEAVES = "array<struct<chars:int,tokens:int>>"


def build_trees(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: id, text, leaves (characters and tokens of each), n_tokens. Meant to be written as a table."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            trees = [TokenTree(enc, text.as_py() or "", leaf) for text in batch.column("text")]
            yield _trees(batch.column("id"), [t.whole() for t in trees], trees)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, text string, leaves {_LEAVES}, n_tokens long").withColumnRenamed("id", id_col)


def _trees(ids: pa.Array, texts: list[str], trees: list[TokenTree], *more: tuple[str, list[int]]) -> pa.RecordBatch:
    leaves = pa.array([[{"chars": len(x), "tokens": n} for x, n in t.leaves()] for t in trees], pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())])))
    cols = [ids, pa.array(texts, pa.string()), leaves, pa.array([t.n_tokens for t in trees], pa.int64()), *(pa.array(x, pa.int64()) for _, x in more)]
    return pa.RecordBatch.from_arrays(cols, ["id", "text", "leaves", "n_tokens", *(k for k, _ in more)])


def edit_trees(trees: DataFrame, edits: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", edits_col: str = "edits", leaf: int = LEAF) -> DataFrame:
    """Stored trees (id, text, leaves) after the edits (id, edits): the same columns, and encoded_chars, of the edited documents.

    The two tables are joined by id; of a stored tree only the regions that edits touch are encoded. edits must have
    one row per id.
    """
    kind = trees.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            out = []
            for text, leaves, changes in zip(*(batch.column(c) for c in ("text", "leaves", "edits"))):
                tree = TokenTree(enc, text.as_py() or "", leaf, [(x["chars"], x["tokens"]) for x in leaves.as_py() or []])
                for e in changes.as_py() or []:
                    tree.edit(e["place"] or 0, e["delete"] or 0, e["insert"] or "")
                out.append(tree)
            yield _trees(batch.column("id"), [t.whole() for t in out], out, ("encoded_chars", [t.encoded for t in out]))

    rows = trees.join(edits.select(id_col, F.col(edits_col).alias("_edits")), id_col).select(F.col(id_col).alias("id"), "text", "leaves", F.col("_edits").alias("edits"))
    return rows.mapInArrow(run, f"id {kind}, text string, leaves {_LEAVES}, n_tokens long, encoded_chars long").withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: id, n_tokens, n_tokens_edited, n_chars_edited, encoded_chars (for the edits).

    edits_col is array<struct<place int, delete int, insert string>>. One pass over Arrow batches, nothing shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column("text"), batch.column("edits")):
                tree = TokenTree(enc, text.as_py() or "", leaf)
                before = tree.n_tokens
                for e in edits.as_py() or []:
                    tree.edit(e["place"] or 0, e["delete"] or 0, e["insert"] or "")
                rows.append((before, tree.n_tokens, tree.n_chars, tree.encoded))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4))], ["id", "n_tokens", "n_tokens_edited", "n_chars_edited", "encoded_chars"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).alias("edits"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_tokens_edited long, n_chars_edited long, encoded_chars long").withColumnRenamed("id", id_col)
