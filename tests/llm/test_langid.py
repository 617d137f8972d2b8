import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import langid

DATA = "/root/testdata/sf0.01"


def brute_bits(train: list[bytes], text: bytes) -> float:
    count = defaultdict(Counter)
    for t in train:
        t = b"\0\0\0" + t
        for i in range(3, len(t)):
            for k in range(4):
                count[t[i - k : i]][t[i]] += 1
    total, t = 0.0, b"\0\0\0" + text
    for i in range(3, len(t)):
        for k in (3, 2, 1, 0):
            c = count.get(t[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if t[i] in c:
                total -= math.log2(c[t[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_against_brute_force():
    r = random.Random(1)
    draw = lambda a, n: "".join(r.choice(a) for _ in range(n)).encode()
    train = {"x": [draw("abcé ", 50) for _ in range(9)], "y": [draw("bcdü", 60) for _ in range(9)]}
    counts = []
    for texts in train.values():
        at = np.cumsum([0, *map(len, texts)])
        counts.append(np.unique(langid.grams(np.frombuffer(b"".join(texts), np.uint8), at), return_counts=True))
    model = langid.Model(list(train), counts)
    texts = [draw("abcdéüz漢 ", n) for n in (0, 1, 2, 5, 80, 200)]
    got = model.text_lengths(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])) / langid.UNIT
    want = [[brute_bits(t, x) for t in train.values()] for x in texts]
    assert np.allclose(got, want, atol=0.1, rtol=1e-3)


def test_blocks_give_the_grams_of_the_whole():
    r = random.Random(6)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 0, 40)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [int.from_bytes((b"\0\0\0" + t)[i : i + 4], "big") for t in texts for i in range(len(t))]
    for step in (1, 2, 3, 5, 100):
        got = np.concatenate([langid.grams(data, at, s, min(len(data), s + step)) for s in range(0, len(data), step)])
        assert got.tolist() == want


def test_predictions_against_brute_force(spark):
    """lang_pred and score of short texts, and a language that has long texts only."""
    r = random.Random(9)
    draw = lambda a, n: "".join(r.choice(a) for _ in range(n))
    learn = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    train = {"x": [draw("abcé ", 30) for _ in range(20)], "y": [draw("abdü ", 30) for _ in range(20)], "z": [draw("acü ", 90000)]}
    rows = [(i, t, lang) for i, (lang, t) in zip(learn, [(k, t) for k, v in train.items() for t in v])]
    tests = [(1000 + i, draw("abcdéü ", r.randint(1, 9)), None) for i in range(60)]
    docs = spark.createDataFrame(rows + tests, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.predict(docs, langid.train(docs)).collect()}
    for i, text, _ in tests:
        bits = [brute_bits([t.encode() for t in train[k]], text.encode()) for k in "xyz"]
        score = 1 / sum(2 ** (min(bits) - b) for b in bits)
        assert abs(got[i].score - (score if any(c.isalpha() for c in text) else 0)) < 0.01
        if score > 0.6 and any(c.isalpha() for c in text):
            assert got[i].lang_pred == "xyz"[bits.index(min(bits))]


def test_edges(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(40)] + [(100, None, "en"), (101, "12 !?", "en"), (None, "the dog", "en"), (102, "die katze", None), (102, "die katze", None), (103, "the dog " * 40000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS held_out")
    model = langid.train(docs)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred == by[101].lang_pred == "und" and by[100].score == 0
    assert by[None].lang_pred == "en" and by[102].lang_pred == "de" and by[103].lang_pred == "en"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_shards_change_nothing_and_drop_nothing(spark):
    """Many languages, each with letters of its own: the same results in one shard, in some, and in one for each language."""
    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    sets = {f"l{i:02d}": "".join(r.sample(letters, 6)) + " " for i in range(12)}
    rows = [(1000 * i + j, "".join(r.choice(a) for _ in range(40)), lang) for i, (lang, a) in enumerate(sets.items()) for j in range(8)]
    docs = spark.createDataFrame([*rows, (5, "", None), (6, None, None), (7, "xyz", None)], "doc_id long, text string, lang string").repartition(3)
    assert langid.cut_languages([("a", 10), ("b", 10), ("c", 5), ("d", 100)], 40) == [["a", "b"], ["c"], ["d"]]
    got = []
    for cells in (1 << 26, 3000, 1):
        model = langid.train(docs, shard_cells=cells)
        got.append(sorted((x.doc_id, x.lang_pred, round(x.score, 9)) for x in langid.predict(docs, model).collect()))
        assert model.n_langs == 12 and len(model.kept) == {1 << 26: 1, 1: 12}.get(cells, len(model.kept)) and (cells != 3000 or 1 < len(model.kept) < 12)
    assert got[0] == got[1] == got[2]
    assert sum(p == dict((i, lang) for i, _, lang in rows).get(d) for d, p, _ in got[0]) >= 90


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).where("held_out").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 100 AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0
