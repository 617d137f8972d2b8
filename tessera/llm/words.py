"""Vectorised words, lines and shingles of whole Arrow batches of text.

Texts stay UTF-8 bytes. A word is a run of bytes other than 0x20 and 0x09-0x0D, which never cuts a code point.
Hashes are 64-bit; equal words always hash alike. A word, line or run of words is the sum of random numbers that depend
on each byte (or word) and its place, so no two strings collide by their structure. Polynomials modulo 2 ** 64, which
some strings of 1,024 bytes defeat, are only used for windows of up to 200 bytes. Long texts are worked on in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is a piece of its own.
PIECE = 1 << 19
#: Bytes of words that are hashed at once.
BLOCK = 1 << 17

_RNG = np.random.default_rng(20240229)
CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A number for each byte at each of 64 places.
TABLE = _RNG.integers(1, 2**63, 64 * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII characters but letters and digits: for words that punctuation parts.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for pieces of the usual size."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        x = np.full(max(n, PIECE + 1), base, np.uint64)
        x[0] = 1
        kept = np.multiply.accumulate(x)
        if n <= 4 * PIECE:
            _powers[int(base)] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) over whole texts, about `size` bytes at a time."""
    data, at = flat(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of code * BASE ** place."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(BASE, len(codes)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of [start, end), free of where it lies."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def runs(size: np.ndarray) -> np.ndarray:
    """0 .. size[0] - 1, 0 .. size[1] - 1, and so on."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Hashes of the non-empty byte spans [start, end): each byte stands for a random number of its place in the span.

    The numbers are added up, so a span may be hashed in parts; `block` bytes are worked on at once, however long it is.
    """
    size = end - start
    first = np.cumsum(size) - size
    total = int(size.sum())
    out = np.zeros(len(start), np.uint64)
    for s in range(0, total, block):
        e = min(total, s + block)
        a, b = int(np.searchsorted(first, s, "right")) - 1, int(np.searchsorted(first, e, "left"))
        low, high = np.maximum(first[a:b], s), np.minimum(first[a:b] + size[a:b], e)
        place = np.arange(s, e) - np.repeat(first[a:b], high - low)
        byte = fold[data[place + np.repeat(start[a:b], high - low)]]
        value = TABLE[((place & 63) << 8) | byte]
        late = np.flatnonzero(place > 63)
        if len(late):
            value[late] = mix(value[late] ^ ((place[late] >> 6).astype(np.uint64) * PLACE[10]))
        out[a:b] += np.add.reduceat(value, low - s)
    return mix(out + size.astype(np.uint64) * PLACE[0])


def hash_runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the non-empty runs [start, end) of hashes, each mixed with its place in the run."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    place = runs(size)
    mixed = mix(values[place + np.repeat(start, size)] + place.astype(np.uint64) * PLACE[11])
    return mix(np.add.reduceat(mixed, np.cumsum(size) - size) + size.astype(np.uint64) * PLACE[2])


class Words:
    """Words of a piece: start, end (bytes), hash, and first (n + 1 word offsets by text)."""

    def __init__(self, data: np.ndarray, at: np.ndarray, fold: np.ndarray = LOWER, apart: np.ndarray = SPACE):
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~apart[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        self.start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        self.end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        self.first = np.searchsorted(self.start, at)
        self.hash = hash_spans(data, self.start, self.end, fold)

    def text_of(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word) of every window of n words that lies in one text."""
        m = len(self.start) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = self.text_of()
        ok = np.flatnonzero(text[:m] == text[n - 1 :])
        h = np.zeros(len(ok), np.uint64)
        for k in range(n):
            h += self.hash[ok + k] * PLACE[1 + k % 60]
            if k % 60 == 59:
                h = mix(h)
        return mix(h), text[ok], ok

    def short_shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) for texts of 1 to n - 1 words: the whole sequence as one shingle."""
        count = np.diff(self.first)
        text = np.flatnonzero((count > 0) & (count < n))
        h = count[text].astype(np.uint64) * PLACE[63]
        for k in range(n - 1):
            has = count[text] > k
            h[has] += self.hash[self.first[text[has]] + k] * PLACE[1 + k % 60]
        return mix(mix(h)), text


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text, hash), sorted by text, then hash."""
    w = Words(data, at)
    h, text, _ = w.shingles(n)
    h2, text2 = w.short_shingles(n)
    h, text = np.concatenate([h, h2]), np.concatenate([text, text2])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]
