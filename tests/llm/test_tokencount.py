import random

import public_tokenizers as P

from tessera.llm.bpe import encoding
from tessera.llm.tokencount import TokenTree, build_trees, count_tokens, edit_trees, standard_edits

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
BITS = ["ab", "é", "漢字", "12", "'s", "'", "s", "!?", " ", "  ", "\n", "\t", "word", " it's"]


def test_edits_against_whole_encoding():
    r, enc = random.Random(7), encoding(RANKS, P.PATTERN)
    for _ in range(120):
        text = "".join(r.choice(BITS) for _ in range(r.randint(0, 80)))
        tree = TokenTree(enc, text, r.choice([1, 4, 16]))
        for _ in range(12):
            place, delete, insert = r.randint(0, len(text) + 2), r.choice([0, 1, 3, 40]), "".join(r.choice(BITS) for _ in range(r.choice([0, 1, 1, 30])))
            p = min(place, len(text))
            text = text[:p] + insert + text[p + delete :]
            tree.edit(place, delete, insert)
            assert tree.whole() == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(enc.encode_ordinary(text)) == sum(n for _, n in tree.leaves())


def test_documents(spark):
    rows = [(1, "Hello world. " * 4000), (2, None), (3, ""), (3, ""), (4, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n_tokens")
    from pyspark.sql import functions as F

    docs = docs.withColumn("edits", F.when(F.col("doc_id") != 2, standard_edits(F.col("doc_id"), F.coalesce("text", F.lit("")))))
    enc = encoding(RANKS, P.PATTERN)
    for e, x in zip(docs.collect(), count_tokens(docs, RANKS, P.PATTERN).collect()):
        text = e.text or ""
        assert x.n_tokens == len(enc.encode_ordinary(text))
        for place, delete, insert in e.edits or []:
            place = min(place, len(text))
            text = text[:place] + insert + text[place + delete :]
        assert x.n_tokens_edited == len(enc.encode_ordinary(text)) and x.n_chars_edited == len(text)
        if x.doc_id == 1:
            assert x.encoded_chars < 3000
    assert count_tokens(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_stored_trees_take_later_edits(spark, tmp_path):
    """Two runs of edits on stored trees: each encodes a few leaves, and the counts are those of the whole texts."""
    enc, long = encoding(RANKS, P.PATTERN), "Hello world, it's a test. " * 4000
    docs = spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string")
    build_trees(docs, RANKS, P.PATTERN).write.parquet(f"{tmp_path}/0")
    texts = {1: long, 2: "", 3: ""}
    for run, changes in enumerate([{1: [(50_000, 3, "new"), (0, 0, "x")], 2: [(0, 0, "some words")]}, {1: [(90_001, 0, " y" * 300)], 3: [(5, 5, "é")]}]):
        edits = spark.createDataFrame([(i, [{"place": p, "delete": d, "insert": s} for p, d, s in e]) for i, e in changes.items()], "doc_id long, edits array<struct<place:int,delete:int,insert:string>>")
        trees = spark.read.parquet(f"{tmp_path}/{run}")
        new = edit_trees(trees, edits, RANKS, P.PATTERN)
        got = {x.doc_id: x for x in new.collect()}
        assert set(got) == set(changes)
        for i, e in changes.items():
            for p, d, s in e:
                p = min(p, len(texts[i]))
                texts[i] = texts[i][:p] + s + texts[i][p + d :]
            assert got[i].text == texts[i] and got[i].n_tokens == len(enc.encode_ordinary(texts[i]))
            assert got[i].encoded_chars < 3000
        trees.join(edits, "doc_id", "left_anti").unionByName(new.drop("encoded_chars")).write.parquet(f"{tmp_path}/{run + 1}")


def test_many_edits_stay_cheap():
    enc, r = encoding(RANKS, P.PATTERN), random.Random(3)
    tree = TokenTree(enc, "one two three " * 2000, 16)
    for _ in range(3000):
        tree.edit(r.randint(0, tree.n_chars), r.choice([0, 0, 2]), r.choice([" a b c d e f g h i j k l", "x"]))
        assert tree._find(tree.n_chars // 2)[2] <= tree.deepest + 12
    assert tree.n_tokens == len(enc.encode_ordinary(tree.whole())) and tree.encoded < 3000 * 200
