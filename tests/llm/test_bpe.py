import hashlib
import random

import public_tokenizers as P
import pytest

from tessera.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("seed", range(6))
def test_parts_give_the_ids_of_the_whole(seed):
    r = random.Random(seed)
    enc = bpe.encoding(RANKS, P.PATTERN)
    bits = ["ab", "é", "漢字", "12", "'s", "'t", "!?", " ", "  ", "\n", "　", "\x1c", "\t\t", "<|endoftext|>", "x" * 40, " " * 5000, "\n" * 4500]
    for _ in range(25):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 120)))
        assert bpe.encode(enc, text, 50) == enc.encode_ordinary(text)
        assert "".join(bpe.parts(text, 50)) == text


def test_documents(spark):
    rows = [(1, "Hello world's end", 7), (2, None, 7), (3, "", 7), (3, "", 8), (4, "é" * 70000 + " x" * 70000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = bpe.encode_documents(docs, RANKS, P.PATTERN, ids=True).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    enc = bpe.encoding(RANKS, P.PATTERN)
    by = {r.doc_id: r for r in got}
    assert by[2].n_tokens == 0 and by[2].token_ids == []
    assert by[4].token_ids == enc.encode_ordinary(rows[-1][1])
    for r in got:
        want = [enc.encode_ordinary(t or "") for i, t, _ in rows if i == r.doc_id][0]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and r.n_tokens == len(want)
        assert r.decoded_sha256 == hashlib.sha256(enc.decode_bytes(want)).hexdigest()
    assert bpe.encode_documents(docs.limit(0), RANKS, P.PATTERN).count() == 0
