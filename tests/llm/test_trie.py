import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import trie


def digest(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute_rebuild(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in own.items()}
    return {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + ts[zlib.crc32(str(c).encode()) % 6 :] for c, ts in own.items()}


def brute(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        childless = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(x) == len(node) + 1 for x in under), len(childless), saved, digest([c for c in who if len(convs[c]) == len(node)])))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS cut", "'x' AS prefixes").repartition(3)


def nodes(df):
    assert [f.name for f in df.schema] == [c.split()[0] for c in trie.NODES.split(", ")]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("least", [2, 1000])
def test_against_brute_force(spark, monkeypatch, least):
    """With almost every subtrie split, and with none split; ties, nulls, repeated rows, empty texts and missing heads."""
    monkeypatch.setattr(trie, "LEAST_TURNS", least)
    r = random.Random(3)
    rows = []
    for c in [*range(100, 150), 205, 0, 7, 300]:
        for t in range(r.randint(1, 7)):
            rows.append((c, r.choice([t, t, t, None, 0]), r.choice(["user", "assistant", None]), r.choice(["a", "b", "é漢", "", None])))
    rows += rows[:3] + [(None, 0, "user", "lost")]
    convs = brute_rebuild(rows)
    got = nodes(trie.build(trie.rebuild(trie.gather(table(spark, rows)))))
    assert got == brute(convs)


def test_conversations_without_turns_and_empty_table(spark):
    gone = next(c for c in range(401, 500) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(gone, 0, "user", "x"), (gone, 1, "user", "y")]  # conversation 400 is absent: nothing is left of it
    got = nodes(trie.build(trie.rebuild(trie.gather(table(spark, rows)))))
    assert got == [(gone, 0, None, 1, 0, 1, 0, digest([gone]))] == brute(brute_rebuild(rows))
    assert nodes(trie.build(trie.gather(table(spark, rows).limit(0)))) == []


def test_hot_groups_are_split_and_copies_meet_once(spark, monkeypatch):
    """A third of all conversations are copies, a third share five turns and fork then; one is very long."""
    monkeypatch.setattr(trie, "LEAST_TURNS", 40)
    rows = [(c, t, "user", f"copy {t}") for c in range(300) for t in range(3)]
    rows += [(c, t, "user", f"stem {t}" if t < 5 else f"fork {c}") for c in range(300, 600) for t in range(6)]
    rows += [(c, 0, "user", f"alone {c}") for c in range(600, 900)] + [(900, t, "user", f"long {t}") for t in range(1500)]
    rows += [(901, t, "user", f"long {t}") for t in range(700)]
    turned = trie.gather(table(spark, rows))
    got = {(x.conv_id, x.depth): x for x in trie.build(turned).collect()}
    assert len(got) == 1 + 3 + 5 + 300 + 300 + 1500
    assert got[0, 0].n_convs == 902 and got[0, 0].n_children == 303 and got[0, 0].n_leaves == 602
    assert got[0, 3][3:] == (300, 0, 1, 299 * 6, digest(range(300))) and got[0, 3].parent_conv_id == 0
    assert got[300, 5][3:] == (300, 300, 300, 299 * 6, digest([])) and got[555, 6].parent_conv_id == 300
    assert got[900, 700].n_convs == 2 and got[900, 700].ends_sha256 == digest([901]) and got[900, 701].saved_tokens == 0
    assert got[900, 1].saved_tokens == sum(len(f"long {t}") for t in range(700))
    seqs = trie.sequences(turned)
    assert seqs.count() == 603
    cut = seqs.join(trie.cuts(seqs, 40), "seq")
    size = cut.selectExpr("get(prefixes, cut - 1) AS p", "size(prefixes) - cut + 1 AS turns").where("p IS NOT NULL").groupBy("p").sum("turns")
    assert size.agg({"sum(turns)": "max"}).first()[0] <= 40
