import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import substrings
from tessera.llm.suffixes import Suffixes


def brute(rows, width):
    """rows of unique ids; repeated rows are one document."""
    seen, out = {}, {}
    for i, text in sorted(set(rows)):
        raw = (text or "").encode()
        for p in range(len(raw) - width + 1):
            seen.setdefault(raw[p : p + width], (i, p))
    for i, text in set(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for p in range(len(raw) - width + 1):
            if seen[raw[p : p + width]] != (i, p):
                gone[p + 1 : p + width + 1] = True
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out[i] = (len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_sort():
    r = random.Random(0)
    for _ in range(40):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 60))]
        group = np.sort(np.array([r.randint(0, 4) for _ in strings]))
        at = np.cumsum([0, *map(len, strings)])
        s = Suffixes(np.frombuffer(b"".join(strings), np.uint8), at[:-1], np.diff(at))
        perm = s.sort(group)
        assert perm.tolist() == sorted(range(len(strings)), key=lambda i: (group[i], strings[i], i))
        common = s.verified(perm, group)
        for k in range(1, len(perm)):
            a, b = strings[perm[k - 1]], strings[perm[k]]
            n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert common[k] == (n if group[perm[k]] == group[perm[k - 1]] else 0)


        by_bytes = s.by_bytes(group)
        assert by_bytes[0].tolist() == perm.tolist() and by_bytes[1].tolist() == common.tolist()


def test_a_collision_falls_back_to_bytes(monkeypatch):
    monkeypatch.setattr(Suffixes, "common", lambda self, a, b: np.minimum(self.length[a], self.length[b]))  # all hashes equal
    strings = [b"abc", b"abd", b"ab", b"xbc"]
    perm, common = substrings._classes(pa.array(strings, pa.binary()), np.zeros(4, np.int64))
    assert perm.tolist() == [2, 0, 1, 3] and common.tolist() == [0, 2, 2, 0]


@pytest.mark.parametrize("seed,width,gram,large", [(1, 100, 40, 2000), (2, 20, 8, 3), (3, 12, 3, 2000), (4, 30, 10, 1)])
def test_against_brute_force(spark, monkeypatch, seed, width, gram, large):
    monkeypatch.setattr(substrings, "BLOCK", 97)
    monkeypatch.setattr(substrings, "LARGE", large)
    monkeypatch.setattr(substrings, "MOST_GROUPS", 5)
    r = random.Random(seed)
    alphabet = ["a", "b", "é", "漢", " "] if seed != 3 else ["a", "b"]
    text = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    passages = [text(r.randint(width // 2, 3 * width)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [text(r.randint(0, 2 * width)) if r.random() < 0.5 else r.choice(passages) for _ in range(r.randint(0, 5))]
        if r.random() < 0.2:
            parts.append(r.choice(["a", "ab", "abé"]) * width)
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 30, 2)] + [(300 + i, rows[i][1][5:-7]) for i in range(0, 30, 3)] + [(400, None), (401, ""), (402, text(9 * width)), (402, "")][:3]
    rows += [rows[3], rows[-5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n_bytes", "3 AS sub").repartition(5)
    got = substrings.dedup(docs, width=width, gram=gram).collect()
    want = brute(rows, width)
    assert len(got) == len(rows)
    for x in got:
        assert tuple(x)[1:] == want[x.doc_id], x


def test_a_large_group_is_cut_and_no_task_sorts_it_whole(spark, monkeypatch):
    """Six hundred documents share a passage, each between texts of its own, some with the bytes next to it in common."""
    sorted_ = []
    real = substrings.sort_ends
    monkeypatch.setattr(substrings, "LARGE", 50)
    monkeypatch.setattr(substrings, "sort_ends", lambda ends, width, gram: sorted_.append(ends.groupBy("hash").count().agg({"count": "max"}).first()[0]) or real(ends, width, gram))
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage, near = word(130), [word(k) for k in (5, 25, 45)]
    rows = [(i, word(60) + (r.choice(near) if i % 2 else "") + passage + (r.choice(near) if i % 3 else "") + word(60)) for i in range(600)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute(rows, 100)
    assert all(tuple(x)[1:] == want[x.doc_id] for x in got) and len(got) == 600
    assert len(sorted_) >= 2 and max(x or 0 for x in sorted_) <= 50


def test_edges(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(None, long), (1, long), (2, "x" + long), (2, long + "y"), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.n_bytes): x.n_removed for x in substrings.dedup(docs).collect() if x.n_bytes}
    assert got[None, 300] == 0 and got[3, 5] == 0 and len(got) == 4 and got[2, 301] in (299, 300)
    assert substrings.dedup(docs.limit(0)).count() == 0
