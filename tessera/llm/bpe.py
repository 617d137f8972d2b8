"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries first: between a character that is no white space and a white space that
follows it. No match of the splitting pattern crosses such a place, and none looks past it, so the ids are those
of the whole text. Very long runs of white space are matched by hand, as the pattern's look-ahead would backtrack.

Null text: empty, no ids. Repeated rows: encoded each. Empty table: empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters to a part of a long text, about.
PART = 1 << 16
#: White space in a row that is matched by hand from this length on.
LONG_SPACE = 1 << 12
#: What the pattern's \s means: White_Space of Unicode. Python's \s also takes 0x1C-0x1F, so it is spelt out.
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_SPACES}])(?=[{_SPACES}])")
_LONG = re.compile(f"[{_SPACES}]{{{LONG_SPACE},}}")


@lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file; loaded once a Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def decimal_ids(path: str, pattern: str) -> list[str]:
    return [str(i) for i in range(encoding(path, pattern).n_vocab)]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about `size` characters that end at safe boundaries; a part is longer where there is none."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str, size: int = PART) -> list[int]:
    """Ids of the whole text, without special tokens."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in parts(text, size):
        at = 0
        for m in _LONG.finditer(part):
            # before the run stands no white space (or nothing), so the run's matches start with it
            ids += enc.encode_ordinary(part[at : m.start()])
            end = m.end() if m.end() == len(part) else m.end() - 1
            ids += enc._encode_single_piece(part[m.start() : end])
            at = end
        ids += enc.encode_ordinary(part[at:])
    return ids


def decode(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The raw bytes of the ids; no replacement of broken code points."""
    return enc.decode_bytes(ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per row of docs: its id, n_tokens, ids_sha256, decoded_sha256, round_trip, and token_ids if ids is set.

    Encoding, decoding and both digests are made in one pass over Arrow batches; nothing is shuffled. Other columns
    of docs are not read.
    """
    extra = ", token_ids array<int>" if ids else ""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name = encoding(path, pattern), decimal_ids(path, pattern)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            kept: list[np.ndarray] = []
            for x in batch.column(1):
                text = x.as_py() or ""
                got = encode(enc, text)
                raw = decode(enc, got)
                rows[0].append(len(got))
                rows[1].append(hashlib.sha256(",".join([name[i] for i in got]).encode()).hexdigest())
                rows[2].append(hashlib.sha256(raw).hexdigest())
                rows[3].append(raw == text.encode())
                if ids:
                    kept.append(np.array(got, np.int32))
            cols = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.bool_())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if ids:
                cols, names = [*cols, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(np.concatenate(kept) if kept else [], pa.int32()))], [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean{extra}")
    return out.withColumnRenamed("id", id_col)
