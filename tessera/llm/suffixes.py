"""Suffix sorting with hash comparisons, vectorised over many groups of short strings.

Prefix polynomial hashes give the hash of any substring, a binary search over them the common extension of two
suffixes, and that a comparison in logarithmic time; mergesort needs no more. All groups, and all elements of a merge,
take their steps together. The order and the common lengths are then verified against the bytes.
"""

from __future__ import annotations

import os

import numpy as np

from tessera.llm.words import CODES, INVERSE, powers, prefix_hashes


class Suffixes:
    """Suffixes start[i] : start[i] + length[i] of one buffer, compared up to those lengths."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = data, start, length
        self.prefix = prefix_hashes(CODES[data])
        self.unplace = powers(INVERSE, len(self.prefix))
        self.top = int(length.max()) if len(length) else 0

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b (numbers), by binary search over hashes."""
        sa, sb = self.start[a], self.start[b]
        pa, pb, ua, ub = self.prefix[sa], self.prefix[sb], self.unplace[sa], self.unplace[sb]
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        for _ in range(max(1, self.top.bit_length())):
            mid = (low + high + 1) >> 1
            same = (self.prefix[sa + mid] - pa) * ua == (self.prefix[sb + mid] - pb) * ub
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b; equal ones by number."""
        k = self.common(a, b)
        over_a, over_b = k >= self.length[a], k >= self.length[b]
        last = len(self.data) - 1
        ca, cb = self.data[np.minimum(self.start[a] + k, last)], self.data[np.minimum(self.start[b] + k, last)]
        return np.where(over_a & over_b, a < b, over_a | (~over_b & (ca < cb)))

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Numbers of the suffixes ordered by group (nondecreasing already), then by suffix: a bottom-up mergesort."""
        n = len(group)
        perm = np.arange(n)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        width = 1
        while len(size) and width < size.max():
            big = size > width
            begin, end = np.repeat(first[big], size[big]), np.repeat(first[big] + size[big], size[big])
            spot = np.arange(len(begin)) - np.repeat(np.cumsum(size[big]) - size[big], size[big]) + begin
            run = (spot - begin) // width
            other = begin + (run ^ 1) * width
            low = np.minimum(other, end)
            high = np.minimum(other + width, end)
            base, me = low.copy(), perm[spot]
            while True:  # how many of the neighbouring run come before me
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                before = self.less(perm[mid], me[open_])
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
            to = begin + (run // 2) * 2 * width + (spot - begin) % width + (low - base)
            merged = perm.copy()
            merged[to] = me
            perm, width = merged, width * 2
        return perm

    def by_bytes(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(perm, common lengths of neighbours) by comparing bytes alone: what a collision of hashes falls back to."""
        raw = [self.data[a : a + n].tobytes() for a, n in zip(self.start, self.length)]
        perm = sorted(range(len(raw)), key=lambda i: (group[i], raw[i], i))
        common = [0] * len(raw)
        for k in range(1, len(perm)):
            if group[perm[k]] == group[perm[k - 1]]:
                common[k] = len(os.path.commonprefix([raw[perm[k - 1]], raw[perm[k]]]))
        return np.array(perm, np.int64), np.array(common, np.int64)

    def verified(self, perm: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        """Common lengths of neighbours in perm (0 between groups), checked byte by byte; None on a collision."""
        a, b = perm[:-1], perm[1:]
        same_group = group[a] == group[b]
        k = np.where(same_group, self.common(a, b), 0)
        pair, want = np.flatnonzero(k > 0), k[k > 0]
        spot = np.arange(want.sum()) - np.repeat(np.cumsum(want) - want, want)
        equal = self.data[np.repeat(self.start[a[pair]], want) + spot] == self.data[np.repeat(self.start[b[pair]], want) + spot]
        over_a, over_b = k >= self.length[a], k >= self.length[b]
        last = max(len(self.data) - 1, 0)
        ca, cb = (self.data[np.minimum(self.start[x] + k, last)] for x in (a, b)) if len(self.data) else (k, k)
        sorted_ = over_a | (~over_b & (ca < cb))
        if not equal.all() or not sorted_[same_group].all():
            return None
        return np.append(0, k)
