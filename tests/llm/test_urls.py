import random
import re
from collections import defaultdict

import duckdb
import pytest

from tessera.llm import queries, urls


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def brute_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def brute_levels(host):
    bare = re.sub(r"\.$", "", re.sub(r":[0-9]*$", "", re.sub("^.*@", "", host)))
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", bare) or bare.startswith("["):
        return bare, ""
    parts = bare.split(".")
    n = 2 if ".".join(parts[-2:]) in urls.TWO_LABEL_SUFFIXES else 1
    return ".".join(parts[-n - 1 :]), ".".join(parts[-n:])


def between(groups):
    """Variance of rates within groups of (rate, square), and each group's own (rate, square)."""
    found, weight = 0, 0
    for g in groups.values():
        h = len(g)
        if h > 1:
            cross = sum(a[0] * b[0] for i, a in enumerate(g) for j, b in enumerate(g) if i != j) / (h * (h - 1))
            found, weight = found + (h - 1) * (sum(x[1] for x in g) / h - cross), weight + h - 1
    v = max(0, found / weight) if weight else 0
    up = {}
    for key, g in groups.items():
        h = len(g)
        up[key] = sum(x[0] for x in g) / h, sum(a[0] * b[0] for i, a in enumerate(g) for j, b in enumerate(g) if i != j) / (h * (h - 1)) if h > 1 else g[0][1] - v
    return v, up


def grouped(items):
    out = defaultdict(list)
    for key, x in items:
        out[key].append(x)
    return out


def brute(pages, labels):
    bad = defaultdict(list)
    for i, q, t in labels:
        if i is not None and (q is not None or t is not None):
            bad[i].append(max(x for x in (t, None if q is None else 1 - q) if x is not None))
    split = [(i, *brute_split(u)) for i, u in pages]
    host_of, by = defaultdict(list), {k: defaultdict(list) for k in ("host", "domain", "suffix", "all")}
    for i, host, _ in split:
        host_of[host] += [max(bad[i])] if i in bad else []
    for host, got in host_of.items():
        domain, suffix = brute_levels(host)
        for level, key in (("host", host), ("domain", (domain, suffix)), ("suffix", suffix), ("all", 0)):
            by[level][key] += got
    var = {}
    var["host"], domains = between(grouped((brute_levels(h), (sum(g) / len(g), sum(g) * (sum(g) - 1) / (len(g) * (len(g) - 1)))) for h, g in by["host"].items() if len(g) > 1))
    var["domain"], suffixes = between(grouped((d[1], x) for d, x in domains.items()))
    var["suffix"], _ = between(grouped((0, x) for x in suffixes.values()))
    everything = by["all"][0]
    mean = sum(everything) / len(everything) if everything else 0

    def shrink(got, prior, v):
        s = 1e6 if v <= 0 else min(max(prior * (1 - prior) / v - 1, 2), 1e6)
        return s, (s * prior + sum(got)) / (s + len(got))

    poor = {}
    for host, got in host_of.items():
        domain, suffix = brute_levels(host)
        _, m = shrink(by["suffix"][suffix], mean, var["suffix"])
        _, m = shrink(by["domain"][domain, suffix], m, var["domain"])
        s, post = shrink(got, m, var["host"])
        a, b = s * m + sum(got), s * (1 - m) + len(got) - sum(got)
        poor[host] = post - (4 / (9 * 0.05) - 1) ** 0.5 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5 > urls.LIMIT
    out = []
    for i, host, path in split:
        rule, says = brute_rule(host, path)
        out.append((i, host, path, rule, says or ("block" if poor[host] else "allow")))
    return out


@pytest.fixture(scope="module")
def planted(spark):
    """Hosts of three domains: one bad as a whole, one good with a single bad host, one good; a hot host with a third of the pages."""
    r, pages, labels = random.Random(6), [], []
    for i in range(3000):
        if i % 3 == 0:
            host, p = "hot.good.org", 0.1
        else:
            domain = r.choice(["spam.org", "mixed.co.uk", "good.org"])
            h = r.randrange(20)
            host, p = f"h{h}.{domain}", {"spam.org": 0.95, "good.org": 0.05, "mixed.co.uk": 0.97 if h == 0 else 0.05}[domain]
        pages.append((i, f"https://{host}/x/{i}?q=a/b#c"))
        if r.random() < 0.7 and "h19" not in host:  # no page of the hosts h19 is labelled
            labels.append((i, int(r.random() >= p), 0))
    return pages, labels


def frames(spark, pages, labels):
    p = spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS n").repartition(3)
    return p, urls.outcomes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_reputation_blocks_what_the_labels_show(spark, planted):
    got = {r.host: r.verdict for r in urls.judge(*frames(spark, *planted)).collect()}
    assert all((v == "block") == (h.endswith("spam.org") or h == "h0.mixed.co.uk") for h, v in got.items()), got
    assert got["h19.spam.org"] == "block" and got["h19.mixed.co.uk"] == "allow"  # by their domains


def test_against_brute_force_and_with_many_blocked_hosts(spark, planted, monkeypatch):
    pages, labels = planted
    odd = ["http://A.Example.COM/en/1", "https://www.example.com/en/", "https://x.www.example.com/en/2", "http://com/", "http://com", "http://xcom/en/", "HTTP://q.net/es/?x", "http://q.net/ES/", "net://net/fr/", "//no/scheme", "", None, "http://", "http://u:p@Host.spam.org:8080/es/", "http://10.0.0.1/a", "http://10.0.0.2:1/a", "http://[::1]/b", "http://spam.org./", "a://b://c/d", "http://x.com?/en/", "http://é.net/fr/é#f"]
    pages = pages + [(10_000 + i, u) for i, u in enumerate(odd)] + [(None, "http://z.org/")] + pages[:2]
    labels = labels + [(10_001, None, 1), (10_002, None, None), (None, 0, 1), labels[0], (labels[0][0], 0, 1)]
    want = sorted(brute(pages, labels), key=str)
    p, bad = frames(spark, pages, labels)
    got = urls.judge(p, bad)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    monkeypatch.setattr(urls, "MAX_BROADCAST_IDS", 2)
    assert sorted(map(tuple, urls.judge(p, bad).collect()), key=str) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)"), con.executemany("INSERT INTO pages VALUES (?, ?)", pages[2980:] + pages[:200])
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)"), con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    r = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op12_url_filter']})").fetchall()
    assert sorted(r, key=str) == sorted(brute(pages[2980:] + pages[:200], labels), key=str)


def test_empty_tables(spark, planted):
    p, bad = frames(spark, *planted)
    assert urls.judge(p.limit(0), bad).count() == 0
    assert {r.verdict for r in urls.judge(p.limit(50), bad.limit(0)).collect()} == {"allow"}
    long = spark.createDataFrame([(1, "http://a.net/es/" + "x" * 2_000_000)], "page_id long, url string")
    assert urls.judge(long, bad).first().verdict == "block"


def test_variances_are_those_of_the_rates(spark):
    """Rates drawn per suffix, domain and host: the pair estimates find the variance of each level."""
    r, rows = random.Random(2), []
    for s in range(80):
        a = 0.5 + r.choice([-0.2, 0.2])
        for d in range(10):
            b = a + r.choice([-0.1, 0.1])
            for h in range(5):
                c = b + r.choice([-0.15, 0.15])
                rows.append((f"{s}.{d}.{h}", f"{s}.{d}", f"{s}", 50, sum(r.random() < c for _ in range(50))))
    v = urls.variances(spark.createDataFrame(rows, "host string, domain string, suffix string, n long, k long"))
    assert abs(v["host"] - 0.0225) < 0.003 and abs(v["domain"] - 0.01) < 0.003 and abs(v["suffix"] - 0.04) < 0.006, v
