import random
import re

import numpy as np

from tessera.llm import decontam


def brute_tiles(t, d, least):
    """Plain greedy string tiling: all longest matches of each round."""
    mt, md, total = [False] * len(t), [False] * len(d), 0
    while True:
        best, found = least - 1, []
        for i in range(len(t)):
            for j in range(len(d)):
                k = 0
                while i + k < len(t) and j + k < len(d) and t[i + k] == d[j + k] and not mt[i + k] and not md[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if best < least:
            return total
        for i, j in found:
            if not any(mt[i : i + best]) and not any(md[j : j + best]):
                mt[i : i + best] = md[j : j + best] = [True] * best
                total += best


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_tiles_are_sound():
    r = random.Random(2)
    for _ in range(150):
        t, d = ([r.randint(1, 4) for _ in range(r.randint(0, 25))] for _ in range(2))
        tiles = decontam.tile(np.array(t, np.uint64), np.array(d, np.uint64), 3)
        spots = [(i + x, j + x) for i, j, k in tiles for x in range(k)]
        assert all(t[i] == d[j] for i, j in spots) and len({i for i, _ in spots}) == len({j for _, j in spots}) == len(spots)


def test_documents(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.randint(16, 40))) for i in range(12)] + [(12, "same " * 40), (90, None), (91, "too short"), (92, "")]
    docs = [(i, text(60)) for i in range(40)]
    for i in range(12):
        w = items[i][1].split()
        half = len(w) // 2
        docs.append((100 + i, text(20) + " " + items[i][1].upper() + "! " + text(20)))
        docs.append((200 + i, " ".join(w[half:]) + "\n" + text(30) + "\n" + " ".join(w[:half])))
        docs.append((300 + i, text(20) + " " + " ".join(w[: len(w) // 3]) + " " + text(20)))
    docs += [(400, None), (401, ""), (100, docs[40][1]), (402, text(9000) + " " + items[3][1]), (403, "same " * 3000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS item")
    b = spark.createDataFrame(items, "item_id long, text string")
    seeds = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    covered = {(i, j): brute_tiles(words(y), words(x), 4) for i, x in docs for j, y in items[:13] if seeds(words(x)) & seeds(words(y))}
    pairs = {(i, j, n) for (i, j), n in covered.items() if n >= 0.5 * len(words(items[j][1]))}
    want = {i for i, _, _ in pairs}
    for block in (decontam.BLOCK_WORDS, 20):
        got = decontam.find(d, b, block_words=block)
        assert {(x.doc_id, x.item_id, x.covered) for x in got.collect()} == pairs and got.where("doc_id = 100").count() == 2  # two texts of one id
        left = decontam.drop_contaminated(d, b, block_words=block)
        assert left.columns == d.columns and sorted(x.doc_id for x in left.collect()) == sorted(i for i, _ in docs if i not in want)
    assert {100 + i for i in range(12)} | {200 + i for i in range(12)} | {402, 403} == want
    assert decontam.find(d.limit(0), b).count() == 0 and decontam.find(d, b.limit(0)).count() == 0


def test_what_a_longer_tile_leaves_of_a_match_is_tiled(spark):
    t = [f"t{i}" for i in range(16)]
    text = " ".join(["a", *t[6:13], "b", "c", *t[1:7], "d"])
    items = spark.createDataFrame([(1, " ".join(t))], "item_id long, text string")
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    assert [(x.n_tiles, x.covered) for x in decontam.find(docs, items).collect()] == [(2, 12)]
    assert decontam.drop_contaminated(docs, items).count() == 0


def test_tiling_covers_what_the_plain_method_covers():
    r = random.Random(3)
    for _ in range(600):
        t, d = ([r.randint(1, r.choice([2, 4, 9])) for _ in range(r.randint(0, 40))] for _ in range(2))
        least = r.randint(2, 5)
        tiles = decontam.tile(np.array(t, np.uint64), np.array(d, np.uint64), least)
        assert sum(k for *_, k in tiles) == brute_tiles(t, d, least), (t, d, least)


def test_long_texts_and_null_ids(spark):
    """A passage deep in a text of two million characters, and rows without an id on either side."""
    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, long), (None, item), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (None, "alpha beta gamma delta epsilon")], "item_id long, text string")
    got = decontam.find(docs, items).select("doc_id", "item_id", "covered").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 7, 30), (None, 7, 30)], key=str)
    assert sorted(x.doc_id for x in decontam.drop_contaminated(docs, items).select("doc_id").collect()) == [2, 3]
