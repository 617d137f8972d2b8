import hashlib
import random
import re
import zlib
from collections import defaultdict

from tessera.llm import repair

SPACE = r"[\x20\x09-\x0D]"


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        shown = re.sub(SPACE, "", x)
        out.append("blank" if not shown else "duplicate" if (r, x) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((r, x))
    return out


def brute(rows):
    """(cost, audit, repaired) by trying every script: keep, rerole or delete each row, with up to two inserts at each place."""
    marks = faults(rows)
    ways = {(0, "", ())}
    inserts = [()] + [(a,) for a in ("user", "assistant")] + [("user", "assistant"), ("assistant", "user")]

    def legal(roles):
        return re.fullmatch(r"s?(ua)*u?", "".join(r[:1] or "-" for r in roles))

    def put(ways, options):
        out = {}
        for cost, audit, done in ways:
            for price, letters, more in options:
                roles = done + more
                if legal([x.split(":", 1)[0] for x in roles]):
                    key = tuple(roles)
                    got = (cost + price, audit + letters, key)
                    # what follows depends on the roles' last initial alone
                    state = roles[-1][:1] if roles else ""
                    out.setdefault(state, set()).add(got)
        return {x for s in out.values() for x in sorted(s)[:60]}

    opt_i = [(5 * len(i), "I" * len(i), tuple(f"{r}:" for r in i)) for i in inserts]
    ways = put(ways, opt_i)
    for (_, role, text), mark in zip(rows, marks):
        options = [(2, "D", ())]
        if mark not in ("blank", "duplicate"):
            extra = 5 if mark == "truncated" else 0
            options += [(extra + 1, "R", (f"{r}:{text}",)) for r in ("user", "assistant")]
            if role[:1] in ("s", "u", "a"):
                options.append((extra, "K", (f"{role}:{text}",)))
        ways = put(put(ways, options), opt_i)
    done = [w for w in ways if re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in w[2]))]
    return min(done)


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS fault", "2 AS digest", "3 AS rows", "4 AS id").repartition(3)


def expected(rows):
    by = defaultdict(list)
    for c, t, r, x in brute_damage(rows):
        by[c].append((t, r, x))
    out = []
    for c in {x[0] for x in rows}:
        own = sorted(by[c], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, text = brute(own) if own else (0, "", ())
        marks = faults(own)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    texts = ["Fine.", "Why?\n ", "cut off", "cut. off", "", " \t\x0b", None, "漢字!", "...", "a:b\nc."]
    rows = []
    for c in [*range(60), None, -7]:
        for t in range(r.randint(1, 6)):
            rows.append((c, r.choice([t, t, t, t + 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "sys", "", None]), r.choice(texts)))
    rows += rows[5:9]
    df = table(spark, rows)
    got = repair.report(df, repair.repair(repair.damage(df)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    none = df.limit(0)
    assert repair.report(none, repair.repair(repair.damage(none))).count() == 0


def test_nothing_left_of_a_conversation(spark):
    gone = [(c, t) for c in range(2000) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(c, t, "user", "Gone.") for c, t in gone]
    df = table(spark, rows)
    got = repair.report(df, repair.repair(repair.damage(df))).collect()
    assert sorted(map(tuple, got)) == sorted((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, _ in gone)


def test_search_against_row_by_row_minima():
    """Dijkstra's results are those of minima over (cost, audit) by state, row by row."""

    def minima(code):
        least = lambda *xs: min((x for x in xs if x), default=None)
        on = lambda e, price, letter: e and (e[0] + price, e[1] + letter)

        def insert(e):
            e = [*e]
            e[2] = least(e[2], *(on(e[j], 5, "I") for j in (0, 1, 3)))
            e[3] = least(e[3], on(e[2], 5, "I"))
            return e

        e = insert([(0, ""), None, None, None])
        for c in code:
            n = [on(x, 2, "D") for x in e]
            if c != "x":
                extra, role = 5 * c.isupper(), c.lower()
                if role == "s":
                    n[1] = least(n[1], on(e[0], extra, "K"))
                for j, to, name in ((0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")):
                    n[to] = least(n[to], on(e[j], extra + 1, "R"), role == name and on(e[j], extra, "K"))
            e = insert(n)
        return least(e[0], e[3])

    r = random.Random(4)
    for _ in range(3000):
        code = "".join(r.choice("suaoSUAOxuaua") for _ in range(r.randint(0, 14)))
        assert repair._search(code) == minima(code), code
    for n in (400, 5000):  # long conversations: memory in proportion to the rows
        code = "".join(r.choice("uauauaoUAx") for _ in range(n))
        assert repair._search(code) == minima(code)


def test_rows_are_repaired(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Well."), (1, 5, "assistant", "No end"), (1, 6, "assistant", "Yes. " * 300_000)]
    got = repair.repair(table(spark, rows)).first()
    assert (got.cost, got.audit) == brute([r[1:] for r in rows])[:2]
    assert tuple(f"{x.role}:{x.text}" for x in got.repaired) == brute([r[1:] for r in rows])[2]
