"""URL filter: rules, and an empirical-Bayes reputation of hosts where no rule fits.

Labelled pages are outcomes (bad or not). A host's rate of bad pages is shrunk towards its registered domain's, that towards its
public suffix's, and that towards the rate of all pages: each level has a beta prior whose mean is the estimate of the
level above and whose strength is measured. With k of n pages bad, a posterior is Beta(s * m + k, s * (1 - m) + n - k).

Strengths come from variances of rates between hosts of a domain, domains of a suffix, and suffixes. For a host, k / n
estimates its rate without bias and k (k - 1) / (n (n - 1)) the rate's square; products of different hosts' rates estimate the
square of their domain's. The difference of the two squares is the variance, and what holds for the domain is carried on to the
next level. Hosts count alike there, so that a hot one does not speak for all. Terms are summed in billionths, as
integers, so that the order of summation does not matter.

A page is blocked where the lower posterior bound of its host's rate exceeds a limit. The bound is mean - z * sd with
z * z = 4 / (9 DELTA) - 1: by the one-sided inequality of Vysochanskij and Petunin (Mercadier and Strobel, 2021), as the
posterior has one mode, the rate is below it with a probability of DELTA at most. Hosts without labels have their domain's prior
as posterior: wide, unless the domain's hosts are alike.

One shuffle of pages by host (url and page_id alone, partial sums first) and one of labels by page_id. Verdicts go back to pages as
the set of blocked hosts: broadcast up to a counted number, and beyond it joined by (host, salt), which splits hot hosts.

Null url, or one without "://": host and path are empty; such pages are a host of their own. Null page_id: never labelled, judged
like others. Repeated labels of a page: bad if any is. Labels with null in one outcome: by the other; null in both: not labelled.
Repeated pages: each counts. Ties of rules: there are none, as rules of one length that fit one url are equal. Empty tables: an
empty result; no labels: nothing is blocked but by rules. Very long urls: no limit. Columns beyond page_id and url, and doc_id
and outcomes, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import MAX_BROADCAST_IDS
from tessera.llm.shared import materialise

#: A host is blocked where the rate of its bad pages exceeds LIMIT with a probability of at least 1 - DELTA.
LIMIT, DELTA = 0.5, 0.05
#: Strengths that a prior may have: pages that it counts for. From 2 on all posteriors have one mode; the largest stands for
#: rates that do not vary at all.
WEAKEST, STRONGEST = 2.0, 1e6
#: Pieces that a host's pages are dealt out to where blocked hosts are too many to be broadcast.
SALTS = 32
#: Public suffixes of two labels that registries sell names under; all other suffixes have one label. Fixed values.
TWO_LABEL_SUFFIXES = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: Rules of the query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first :// and the next / ? # or end; from there to the next ? # or end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; user, port and a last dot are left out. An address is its own domain, without a suffix."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$") | bare.startswith("[")
    n = F.when(F.substring_index(bare, ".", -2).isin(*TWO_LABEL_SUFFIXES), 2).otherwise(1)
    suffix = F.when(n == 2, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(n == 2, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return F.when(address, bare).otherwise(domain), F.when(address, "").otherwise(suffix)


def fitting_rule(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad 0 or 1) from labels (doc_id, quality, toxic): bad if toxic, or not of quality."""
    bad = F.greatest(F.col("toxic").cast("int"), 1 - F.col("quality").cast("int"))
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))


def _total(x: Column) -> Column:
    """Sum in billionths, exact in any order."""
    return F.sum(F.floor(x * 1e9).cast("decimal(20,0)")).cast("double") / 1e9


def _between(level: DataFrame, parent: str | None) -> tuple[float, DataFrame]:
    """Variance of rates of a level's units within their parents, and the parents with their own r and r2.

    level: r estimates a unit's rate, r2 that rate's square. A parent with one unit says nothing of the variance; its square is
    that of the unit less the variance found in the others.
    """
    by = [parent] if parent else []
    sums = level.groupBy(*by).agg(F.count("*").cast("double").alias("h"), _total(F.col("r")).alias("s1"), _total(F.col("r") * F.col("r")).alias("s2"), _total(F.col("r2")).alias("p")).where("h > 0")
    cross = (F.col("s1") * F.col("s1") - F.col("s2")) / (F.col("h") * (F.col("h") - 1.0))
    sums = sums.withColumn("cross", F.when(F.col("h") > 1, cross))
    got = sums.where("h > 1").agg(_total((F.col("h") - 1.0) * (F.col("p") / F.col("h") - F.col("cross"))).alias("v"), F.sum(F.col("h") - 1.0).alias("w")).first()
    variance = max(0.0, got["v"] / got["w"]) if got["w"] else 0.0
    return variance, sums.select(*by, (F.col("s1") / F.col("h")).alias("r"), F.coalesce("cross", F.col("p") - F.lit(variance)).alias("r2"))


def variances(counts: DataFrame) -> dict[str, float]:
    """Mean rate of labelled pages, and variances of rates of hosts within domains, domains within suffixes, and suffixes.

    counts: (host, domain, suffix, n, k), one row per host. Hosts with one labelled page tell nothing of variances.
    """
    n, k = counts.agg(F.sum("n"), F.sum("k")).first()
    n1, k1 = F.col("n") - 1.0, F.col("k") - 1.0
    hosts = counts.where("n > 1").select("domain", "suffix", (F.col("k") / F.col("n")).alias("r"), (F.col("k") * k1 / (F.col("n") * n1)).alias("r2"))
    of_host, domains = _between(hosts.withColumn("within", F.struct("domain", "suffix")), "within")
    of_domain, suffixes = _between(domains.withColumn("suffix", F.col("within.suffix")), "suffix")
    of_suffix, _ = _between(suffixes, None)
    return {"mean": k / n if n else 0.0, "host": of_host, "domain": of_domain, "suffix": of_suffix}


def _strength(mean: Column, variance: float) -> Column:
    """Strength of a beta prior with this mean and variance."""
    if variance <= 0:
        return F.lit(STRONGEST)
    return F.least(F.greatest(mean * (1.0 - mean) / F.lit(variance) - 1.0, F.lit(WEAKEST)), F.lit(STRONGEST))


def host_reputation(pages: DataFrame, bad: DataFrame) -> DataFrame:
    """host, domain, suffix, n_pages, n, k, prior_mean, prior_strength, mean, bound: one row per host of pages (page_id, url).

    bad: (page_id, bad), one row per labelled page. n of a host's pages are labelled, k of them bad.
    """
    host, _ = split_url(F.col("url"))
    seen = pages.select("page_id", host.alias("host")).join(bad, "page_id", "left")
    counts = seen.groupBy("host").agg(F.count("*").alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = levels(F.col("host"))
    counts = materialise(counts.select("*", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    v = variances(counts)
    n, k = F.col("n"), F.col("k")

    def shrunk(level: DataFrame, prior: Column, variance: float, name: str) -> DataFrame:
        s = _strength(prior, variance)
        return level.select("*", prior.alias(f"{name}_prior"), s.alias(f"{name}_strength")).withColumn(name, (F.col(f"{name}_strength") * F.col(f"{name}_prior") + k) / (F.col(f"{name}_strength") + n))

    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = shrunk(sums(counts, "suffix"), F.lit(v["mean"]), v["suffix"], "of_suffix").select("suffix", "of_suffix")
    domains = shrunk(sums(counts, "domain", "suffix").join(suffixes, "suffix"), F.col("of_suffix"), v["domain"], "of_domain").select("domain", "suffix", "of_domain")
    got = shrunk(counts.join(domains, ["domain", "suffix"]), F.col("of_domain"), v["host"], "mean")
    a, b = F.col("mean_strength") * F.col("mean_prior") + k, F.col("mean_strength") * (1.0 - F.col("mean_prior")) + (n - k)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0)))
    z = (4.0 / (9.0 * DELTA) - 1.0) ** 0.5
    return got.select("host", "domain", "suffix", "n_pages", "n", "k", F.col("mean_prior").alias("prior_mean"), F.col("mean_strength").alias("prior_strength"), "mean", (F.col("mean") - F.lit(z) * sd).alias("bound"))


def judge(pages: DataFrame, bad: DataFrame, rules: Iterable[Rule] = RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of each row of pages (page_id, url)."""
    pages = pages.select("page_id", "url")
    blocked = materialise(host_reputation(pages, bad).where(F.col("bound") > limit).select("host"), "blocked")
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("ruled"))
    if blocked.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        rows = rows.join(F.broadcast(blocked.withColumn("poor", F.lit(True))), "host", "left")
    else:
        salted = blocked.select("host", F.lit(True).alias("poor"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS))).join(salted.hint("shuffle_hash"), ["host", "salt"], "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("poor"), "block").otherwise("allow")).alias("verdict"))
