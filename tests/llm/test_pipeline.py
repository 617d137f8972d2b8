import hashlib
import random

import corpus_pipeline
import public_tokenizers as P
import pytest
import test_decontam
import test_jaccard
import test_pii
import test_quality

from tessera.llm import decontam, pii, quality
from tessera.llm.bpe import encoding


def fixture():
    r = random.Random(11)
    vocab = [f"word{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(vocab) + ("\n" if r.random() < 0.1 else "") for _ in range(n))
    items = [(i, text(24)) for i in range(4)]
    docs = [(i, text(r.choice([20, 70, 90])), "en", r.choice(["a", "b", None])) for i in range(40)]
    for k in range(6):
        i, t, lang, host = docs[3 * k + 1]
        w = t.split(" ")
        w[5] = "changed"
        docs.append((50 + k, " ".join(w), lang, host))
        docs.append((60 + k, text(60) + " " + items[k % 4][1] + " " + text(20), "en", "a"))
        docs.append((70 + k, text(60) + " mail me.x@example.com or +1 (017) 555-7713 call 4111 1111 1111 1111 " + text(9), "en", "b"))
    docs += [(90, None, None, None), (91, "", "en", "a"), (92, "spam " * 200, "en", "a"), (93, text(80), "en", "b"), (93, docs[0][1], "en", "b")]
    docs += [(100 + i, "\n".join(["Home menu about us and contact", str(i), *text(20).split("\n"), "Home menu about us and contact"] * 1) + " " + text(50), "en", "c") for i in range(30)]
    return docs[:-31] + docs[-30:], items  # ids are unique


def brute(docs, items):
    keep = {x[0] for x in test_quality.brute([(d[0], d[1], d[3]) for d in docs], quality.MAX_DOCS, least=50) if x[-1]}
    docs = [d for d in docs if d[0] in keep]
    groups = test_jaccard.brute([(d[0], d[1]) for d in docs], 5, 80)
    docs = [d for d in docs if groups[d[0]][1] == d[0]]
    bad = {d[0] for d in docs for _, y in items if test_decontam.brute_tiles(w := test_decontam.words(y), test_decontam.words(d[1]), decontam.MIN_TILE) >= decontam.MIN_COVER * len(w)}
    return [d for d in docs if d[0] not in bad]


def test_against_brute_force(spark, tmp_path):
    docs, items = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "CAST(length(text) AS long) AS n_chars")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(docs, items)
    assert sorted(got) == sorted(d[0] for d in want) and len(want) > 25
    enc = encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for i, text, _, _ in want:
        spans = sorted((a, b, k) for k, a, b in test_pii.brute(text))
        out, at = "", 0
        for a, b, k in spans:
            out, at = out + text[at:a] + f"<{k.upper()}>", b
        raw = (out + text[at:]).encode()
        assert got[i].decoded_sha256 == hashlib.sha256(raw).hexdigest() and got[i].token_ids == enc.encode_ordinary(raw.decode())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, tmp_path, stage):
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, None, None, None, None), (1, "a b", None, "h", 3), (1, "a b", None, "h", 3), (2, "x@y.z " * 60, "en", "h", 360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS n", "2 AS id", "3 AS _key", "4 AS _spans", "5 AS _host")
    got = stage(spark, docs, str(tmp_path))
    rows = got.collect()
    if stage is not corpus_pipeline.tokens:
        assert got.schema.simpleString() == docs.schema.simpleString()
        assert {tuple(x)[5:] for x in rows} <= {(1, 2, 3, 4, 5)}  # no value of the caller's changes
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_masked_overlaps(spark):
    docs = spark.createDataFrame([(1, "é 1.2.3.4 a@b.c", 15)], "doc_id long, text string, n_chars long")
    assert tuple(pii.mask(docs).first()) == (1, "é <IP> <EMAIL>", 14)
