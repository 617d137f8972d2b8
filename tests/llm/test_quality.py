import random
import re
from collections import Counter, defaultdict

from tessera.llm import quality


def brute(rows, max_docs, least=5):
    out, seen = [], defaultdict(set)
    parsed = []
    for _, text, host in rows:
        lines = [(x, re.findall(r"[^\x20\x09-\x0D]+", x)) for x in (text or "").split("\n")]
        lines = [(x, w, " ".join(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m.group().lower(), v)) for v in w)) for x, w in lines if w]
        for _, _, n in lines:
            seen[host, n].add(text)  # distinct documents; exact copies are one
        parsed.append(lines)
    for (i, text, host), lines in zip(rows, parsed):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        c = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        rep = {j + k for j in range(len(words) - 2) if c[tuple(words[j : j + 3])] > 1 for k in range(3)}
        left = len(words) - sum(len(w) for _, w, n in lines if len(seen[host, n]) > max_docs)
        failed = len(words) < least or 100 * len(rep) > 50 * len(words)
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len({x for x, _, _ in lines}), len(rep), failed, not failed and left >= least and 2 * left >= len(words)))
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    lines = ["Menu 12 | home", "menu  34 | home", "", "   ", "é ü # x", "漢字 *", "a b c", "a b c a b c", "one two three four five six seven", "x\ty\x0bz", "\x1cq"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 9))), r.choice(["h1", None])) for i in range(120)] + [(500, None, "h1"), (501, "", None), (501, "", None), (502, "w " * 30000, "h2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n", "2 AS lines", "3 AS n_words")
    got = quality.assess(docs.repartition(3), max_docs=6, min_words=5).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 6))
    assert quality.assess(docs.limit(0)).count() == 0


def test_a_block_of_lines_counts_documents(spark):
    """Ten menu lines of 30 documents go, though eight of them always have the same neighbours; copies of a text count once."""
    menu = [" ".join(f"{chr(97 + i)}{w}" for w in ("one", "two", "three", "four", "five", "six")) for i in range(10)]
    body = lambda i: f"body{i} " + " ".join(f"w{i}x{j}" for j in range(19))
    rows = [(i, "\n".join([*menu[:5], body(i), *menu[5:]]), "h") for i in range(30)]
    rows += [(100 + i, "\n".join([*menu, body(100)]), "copies") for i in range(30)]
    # a refrain of one document stands between 40 different lines of it
    rows.append((200, "\n".join(x for i in range(40) for x in (menu[0], f"verse{i} {body(i)}")), "song"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: (x.n_words, x.n_words_left, x.kept) for x in quality.assess(docs.repartition(5), min_words=20).collect()}
    assert got == {i: (80, 20, False) if i < 100 else (80, 80, True) if i < 200 else (40 * 27, 40 * 27, True) for i, _, _ in rows}


def test_kept_rows_are_unchanged(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60)), "h", 42, "k", 7) for i in range(3)], "doc_id long, text string, source string, _key int, _host string, _id int")
    assert sorted(map(tuple, quality.keep(docs).collect())) == sorted(map(tuple, docs.collect()))
