import random
import re

import numpy as np
import pytest

from tessera.llm import graph, jaccard, words


def brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = ["the", "and", "of", "to"] * 6 + [f"W{i}" for i in range(120)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    passage, out = text(14), []
    base = [text(r.choice([3, 8, 25, 40, 90])) for _ in range(n // 8)]
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.8 else text(30)
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.2:
            w = passage + w
        out.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    return out + [(1000, None), (1001, ""), (1002, " "), (1003, "one two"), (1004, "One  two"), (1005, "one")]


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_against_brute_force(spark, seed, width, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS component_id")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.find_groups(docs, width=width, percent=percent).collect()}
    assert got == brute(rows, width, percent)


@pytest.mark.parametrize("pure", [False, True])
def test_a_passage_that_many_share_forms_few_pairs(spark, monkeypatch, pure):
    """Each of 500 documents is a passage and some words of its own, too few and too many to link: their prefixes hold the passage's
    shingles, but no two of them meet. A document that is the passage alone links with all."""
    formed, real = [], jaccard.materialise

    def spy(df, tag):
        got = real(df, tag)
        if tag == "open":
            formed.append(sum(r.light * r.n for r in got.selectExpr("shingle", "int(light) AS l").groupBy("shingle").agg({"l": "sum", "shingle": "count"}).toDF("shingle", "light", "n").collect()))
        elif tag == "pairs":
            formed.append(got.count())
        return got

    monkeypatch.setattr(jaccard, "materialise", spy)
    r = random.Random(9)
    passage = [f"p{i}" for i in range(200)]
    rows = [(i, " ".join([*passage[:100], *(f"own{i}x{j}" for j in range(17)), *passage[100:]])) for i in range(500)]
    rows += [(900, " ".join(passage))] * pure
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in jaccard.find_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=4, percent=85).collect()}
    assert got == ({i: 0 for i, _ in rows} if pure else {i: i for i, _ in rows})
    assert sum(formed) <= 20 * len(rows), formed


def test_edges(spark, monkeypatch):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(graph.join_ids, "__defaults__", (0,))  # the way beyond the bound
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.find_groups(docs, width=4, percent=85).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1), (3, 3)]
    assert sorted(r.doc_id or 0 for r in jaccard.drop_near_copies(docs).collect()) == [0, 0, 1, 3]
    assert jaccard.find_groups(docs.limit(0)).count() == 0


def test_signatures_differ_no_more_than_sets(spark):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 900, k).astype(np.uint64)) for k in (0, 1, 5, 60, 300, 700, 700)] + [np.unique(r.integers(0, 9000, 5000).astype(np.uint64))]
    text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    got = jaccard.signatures(text, jaccard.mix(np.concatenate(sets)), np.array([len(s) for s in sets])).to_pylist()
    assert [len(s) for s in got][:3] == [1, 1, 1] and len(got[-1]) == 128
    rows = spark.createDataFrame([(i, j, got[i], got[j]) for i in range(len(sets)) for j in range(len(sets))], "i int, j int, x array<long>, y array<long>")
    for x in rows.select("i", "j", jaccard.differing(rows.x, rows.y).alias("differ")).collect():
        apart = len(np.setxor1d(sets[x.i], sets[x.j]))
        assert x.differ <= apart and x.differ % 2 == apart % 2
        if x.i != x.j and {x.i, x.j} == {4, 5}:
            assert x.differ > 0.4 * apart


def test_structured_words_do_not_collide(spark):
    """A polynomial modulo 2 ** 64 gives the two Thue-Morse words of 2,048 letters one hash, whatever its base."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, f"{a} one two three four"), (2, f"{b} one two three four"), (3, " ".join(a)), (4, " ".join(b))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.find_groups(docs, width=5, percent=80).collect()}
    assert got[1] == 1 and got[2] == 2


def test_one_id_with_several_texts(spark):
    """Of two texts under one id both stay, unless they are copies; the id's order comes first, then the text's hash."""
    one, two = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(5, one, "a"), (5, two, "b"), (5, two, "c"), (6, one, "d"), (None, one, "e"), (7, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    got = sorted(tuple(x) for x in jaccard.drop_near_copies(docs).select("doc_id", "text").collect() if x.doc_id)
    assert got == sorted([(5, one), (5, two), (7, None)], key=lambda x: (x[0], x[1] or ""))
    assert jaccard.drop_near_copies(docs).count() == 4 and jaccard.drop_near_copies(docs).columns == docs.columns


def test_long_texts_are_hashed_in_blocks():
    r = random.Random(8)
    text = (" ".join("x" * r.randint(1, 300) for _ in range(300)) + " " + "y" * 5000 + " end").encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    w = words.Words(data, at)
    for block in (1, 7, 64, 1000, 1 << 20):
        assert (words.hash_spans(data, w.start, w.end, words.LOWER, block) == w.hash).all()
    assert len(set(w.hash.tolist())) == len(set(text.split()))


def test_components_of_many_large_ids(spark):
    """The test for a change must not overflow: sums of hashes did, beyond about 2 ** 24 edges."""
    edges = spark.range(200_000).selectExpr("id * 40000000000000 AS a", "(id - id % 1000) * 40000000000000 AS b")
    got = graph.components(edges)
    assert got.count() == 200_000 and got.where("label <> node - node % 40000000000000000").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 7), (200, 201), (5, 5), (200, 201)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 0, 200: 200, 201: 200}


def test_components_that_do_not_settle_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError, match="settle"):
        graph.components(edges, rounds=2)
