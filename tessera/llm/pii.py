"""Personal data: base patterns plus bootstrapped contextual extraction, with Spark expressions only.

Base kinds are fixed patterns with a check each; their spans always stay. The method then learns from them. What stands
around an entity, and what it looks like, are its lexical patterns, from special to general: the two words left of it; the
word left of it with its shape; the word right of it with its shape; its shape; the end of its shape; its shape with runs of digits
as one, if it has three separators. (In a shape digits are 0, runs of letters a.) Each (pattern, instance) pair is an edge of a graph. Round by round Spark scores patterns by the
share of their distinct instances that are known, and instances by their best pattern, until no share grows any more; tokens
that look like identifiers and have a pattern of high confidence become further spans, under the kind of the best. Such tokens
are runs with some digits, numbers with brackets, blanks and dashes, and addresses without a dot.

General patterns need more known instances (MIN_SHAPED) than the two words (MIN_KNOWN). They do not overrule a check: a token that
is all of a base pattern's match, and failed its check, is of that kind by its two words alone, and is no instance of other patterns
for that kind. Of kinds with equal shares the
last by name wins.

Positions count code points, end exclusive. Null text: empty. Null id: a row like others. Repeated rows: each gets its own
result. Empty table: empty result. Spans of different kinds may overlap and start alike; they are listed by kind. Columns other than the id and the text are not read. Instances leave the scan as 64-bit hashes only.

The patterns below are the given ones, written so that Java neither recurses nor scans a run twice: possessive where
no backtracking could succeed, and an email starts at the start of a run or where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.expr import let
from tessera.llm.graph import MAX_BROADCAST_IDS
from tessera.llm.shared import fresh_name, materialise, release

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind, tested before its pattern runs.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Tokens that may be identifiers: at least six characters, of them four digits.
TOKEN = r"[A-Za-z0-9](?:[A-Za-z0-9_/-])*+"
MIN_TOKEN, MIN_DIGITS = 6, 4
#: Numbers in pieces: digits with single blanks, dots, dashes or brackets between them, of NUMBER_DIGITS digits at least.
NUMBER = r"(?<![A-Za-z0-9_/+-])\(?[0-9]++(?:[\x20.-]?[()]?[\x20.-]?[0-9]++)++"
NUMBER_DIGITS = 7
ADDRESS = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
#: Characters left of an entity that are looked at, and the words of them that make a pattern.
CONTEXT = 64
#: A pattern counts from this many known instances (the two words, and patterns that hold a shape) and this share of its instances on.
MIN_KNOWN, MIN_SHAPED, MIN_SHARE = 3, 10, 0.5
#: Characters of a shape's end that are a pattern, for values of NUMBER_DIGITS digits and more.
TAIL = 14
#: Rounds end when no pattern is new and no share has grown by more than this.
SETTLED = 1e-3

_BLOCK = 64


def running(lengths: Column) -> Column:
    """Sums of the lengths before each place (0 first), one more than lengths; blocks keep it near linear."""
    n = F.size(lengths)
    total = lambda at, k: F.aggregate(F.slice(lengths, at, k), F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / _BLOCK).cast("int")), lambda b: total(b * _BLOCK + 1, F.lit(_BLOCK)))
    starts = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return let(starts, lambda s: F.transform(F.sequence(F.lit(0), n), lambda i: F.element_at(s, F.floor(i / _BLOCK).cast("int") + 1) + total(F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)))


def left_words(gap: Column, words: int = 2) -> Column:
    """The last words of the text left of an entity (fewer if there are fewer), lower-case, digits masked; empty if there are none."""
    pattern = r"(\S+\s+){0,%d}\S+\s*$" % (words - 1)
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.substring(gap, -CONTEXT, CONTEXT), pattern, 0)), r"[0-9]", "0"), r"\s+", " ")


def right_word(gap: Column) -> Column:
    """The word that the text right of an entity starts with, likewise."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.substring(gap, 1, CONTEXT), r"^\s*\S+", 0)), r"[0-9]", "0")


def shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"[0-9]", "0"), r"\p{L}+", "a"), r"\s", " ")


_FOUND = "array<struct<start:int,end:int,value:string,left:string,word:string,right:string>>"


def matches(text: Column, pattern: str, ok) -> Column:
    """array<struct<start, end, value, left, word, right>> of the leftmost non-overlapping matches for which ok(value) holds.

    split() and regexp_extract_all() walk the same matches, so the gaps' and matches' lengths give the positions.
    """

    def spans(x: Column) -> Column:
        lengths = F.zip_with(x["found"], F.slice(x["gaps"], 1, F.size(x["found"])), lambda m, g: F.length(m) + F.length(g))
        span = lambda m, end, gap, after: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value"), left_words(gap).alias("left"), left_words(gap, 1).alias("word"), right_word(after).alias("right"))
        placed = let(let(lengths, running), lambda ends: F.transform(x["found"], lambda m, i: F.struct(m.alias("m"), ends[i + 1].alias("end"), i.alias("i"))))
        return F.transform(F.filter(placed, lambda p: ok(p["m"])), lambda p: span(p["m"], p["end"], x["gaps"][p["i"]], x["gaps"][p["i"] + 1]))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(found, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _small_parts(value: Column) -> Column:
    bare = lambda p: F.regexp_replace(p, r"^0+(?=.)", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.substring(bare(p), 1, 3).cast("int") <= 255))


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": _small_parts,
    "card": lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def base_matches(text: Column, kind: str) -> Column:
    need = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike(r"[0-9][\x20-]?[0-9]")
    return F.when(need, matches(text, PATTERNS[kind], CHECKS[kind])).otherwise(F.array().cast(_FOUND))


def candidate_tokens(text: Column) -> Column:
    ok = lambda v: (F.length(v) >= MIN_TOKEN) & (F.length(_digits(v)) >= MIN_DIGITS)
    pattern = r"(?<![A-Za-z0-9_/-])(?=[A-Za-z_/-]*+[0-9])" + TOKEN
    none = F.array().cast(_FOUND)
    runs = F.when(text.rlike(r"[0-9]"), matches(text, pattern, ok)).otherwise(none)
    addresses = F.when(text.contains("@"), matches(text, ADDRESS, lambda v: F.lit(True))).otherwise(none)
    pieces = F.when(text.rlike(r"[0-9][\x20.()-]+[0-9]"), matches(text, NUMBER, lambda v: (F.length(_digits(v)) >= NUMBER_DIGITS) & v.rlike(r"[^0-9-]"))).otherwise(none)
    apart = lambda t, others: ~F.exists(others, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    both = lambda first, more: let(first, lambda a: F.concat(a, F.filter(more, lambda t: apart(t, a))))
    return both(both(addresses, pieces), runs)


def _weak(s: Column) -> Column:
    """Hashes of the patterns that hold a shape."""
    def of(x: Column) -> Column:
        # the end of a shape starts where a piece of the value starts, and a short number is its own end
        whole = (F.length(x) == TAIL) | ~F.substring(x, -TAIL - 1, 1).rlike(r"[\p{L}0]")
        tail = F.when((F.length(x) >= TAIL) & whole & (F.length(_digits(s["value"])) >= NUMBER_DIGITS), F.concat(F.lit("end\t"), F.substring(x, -TAIL, TAIL)))
        form = F.when(F.length(F.regexp_replace(x, r"[\p{L}0]", "")) >= 3, F.concat(F.lit("form\t"), F.regexp_replace(x, "0+", "0")))
        texts = F.array(F.when(s["word"] != "", F.concat(F.lit("left\t"), s["word"], F.lit("\t"), x)), F.when(s["right"] != "", F.concat(F.lit("right\t"), s["right"], F.lit("\t"), x)), F.concat(F.lit("shape\t"), x), tail, form)
        return F.transform(F.array_compact(texts), lambda t: F.xxhash64(t))

    return let(shape(s["value"]), of)


def refuted(value: Column) -> Column:
    """The kinds, comma-joined, whose pattern a value matches as a whole but whose check it fails."""
    bare = {"email": PATTERNS["email"], "ip": PATTERNS["ip"], "card": PATTERNS["card"], "phone": PATTERNS["phone"]}
    return F.array_join(F.array_compact(F.array(*[F.when(value.rlike(f"^(?:{p})$") & ~CHECKS[k](value), k) for k, p in bare.items()])), ",")


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each row of docs: id, n (its number), key (a hash of the text), base and tokens, arrays of struct<kind, start,
    end, left, weak, value, refuted>.

    Values and patterns are hashes. Written to the shared folder, so that the texts are scanned once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n"), F.xxhash64(text).alias("key"), text.alias("text"))
    got = got.select("id", "n", "key", *[base_matches(F.col("text"), k).alias(k) for k in KINDS], candidate_tokens(F.col("text")).alias("tokens"))
    left = lambda s: F.when(s["left"] != "", F.xxhash64(s["left"]))
    hidden = lambda s, k: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), left(s).alias("left"), _weak(s).alias("weak"), F.xxhash64(s["value"]).alias("value"), (F.lit("") if k else refuted(s["value"])).alias("refuted"))
    as_kind = lambda k: lambda s: hidden(s, k)
    base = F.concat(*[F.transform(k, as_kind(k)) for k in KINDS])
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    got = got.select("id", "n", "key", base.alias("base"), "tokens")
    return materialise(got.select("id", "n", "key", "base", F.transform(F.filter("tokens", free), lambda s: hidden(s, "")).alias("tokens")), "pii")


def _edges(spans: DataFrame) -> DataFrame:
    """(pattern, strong, value, kind, refuted) of rows with a span s, and their other columns."""
    more = [c for c in spans.columns if c != "s"]
    strong = F.when(F.col("s.left").isNotNull(), F.array(F.struct(F.col("s.left").alias("pattern"), F.lit(True).alias("strong")))).otherwise(F.array().cast("array<struct<pattern:bigint,strong:boolean>>"))
    all_ = F.concat(strong, F.transform("s.weak", lambda w: F.struct(w.alias("pattern"), F.lit(False).alias("strong"))))
    return spans.select(*more, F.explode(all_).alias("p"), "s").select(*more, "p.pattern", "p.strong", "s.value", "s.kind", "s.refuted", "s.start", "s.end")


def _may(kind: str = "kind") -> Column:
    """Whether a pattern may say of an instance that it is of a kind: a shape does not overrule the kind's check."""
    return F.col("strong") | ~F.array_contains(F.split("refuted", ","), F.col(kind))


def score_patterns(seen: DataFrame) -> DataFrame:
    """(pattern, kind, share): patterns of high confidence over the pattern-instance graph; a table that the caller releases.

    A pattern's share of a kind is the sum of its instances' scores by the number of its distinct instances (without those that the
    kind's check refutes, if the pattern holds a shape); a known
    instance scores 1, another one the best share of its accepted patterns. Shares only grow, and are at most 1; the rounds
    end when one adds no pattern and raises no share by more than SETTLED.
    """
    spans = seen.select(F.explode(F.concat("base", "tokens")).alias("s"))
    edges = materialise(_edges(spans).select("pattern", "strong", "value", "kind", "refuted").distinct(), "pii-edges")
    known = edges.where("kind <> ''").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    # an instance may be a seed in one place and a token in another; it is one instance, and a check that it passed stands
    pairs = edges.groupBy("pattern", "strong", "value").agg(F.min("refuted").alias("refuted"))
    no = lambda k: F.count_if(~F.col("strong") & F.array_contains(F.split("refuted", ","), k)).alias(f"no_{k}")
    many = pairs.groupBy("pattern").agg(F.count("*").alias("n"), *[no(k) for k in KINDS])
    against = F.lit(0)
    for k in KINDS:
        against = F.when(F.col("kind") == k, F.col(f"no_{k}")).otherwise(against)
    scored, patterns = known, None
    while True:
        f = pairs.join(scored, "value").where(_may()).groupBy("pattern", "strong", "kind").agg(F.sum("score").alias("known"))
        enough = F.col("known") >= F.when(F.col("strong"), MIN_KNOWN).otherwise(MIN_SHAPED) - 1e-9
        now = f.where(enough).join(many, "pattern").select("pattern", "kind", (F.col("known") / (F.col("n") - against)).alias("share")).where(F.col("share") >= MIN_SHARE - 1e-9)
        now = materialise(now, "pii-patterns")
        if patterns is not None:
            old = patterns.withColumnRenamed("share", "old")
            grown = now.join(old, ["pattern", "kind"], "left").agg(F.max(F.col("share") - F.coalesce("old", F.lit(0.0)))).first()[0]
            release(patterns)
            if grown is None or grown <= SETTLED:
                break
        elif not now.limit(1).count():
            break
        patterns = now
        few = patterns.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
        new = pairs.join(F.broadcast(patterns) if few else patterns, "pattern").where(_may()).groupBy("value", "kind").agg(F.max("share").alias("score"))
        scored = known.unionByName(new).groupBy("value", "kind").agg(F.max("score").alias("score"))
    release(edges)
    return now


def added_spans(seen: DataFrame, patterns: DataFrame) -> DataFrame:
    """(n, start, end, kind) of the tokens that a pattern says to be of a kind: that of the largest share, the last by name among equals."""
    few = patterns.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    tokens = _edges(seen.select("n", F.explode("tokens").alias("s"))).drop("kind", "value")
    got = tokens.join(F.broadcast(patterns) if few else patterns, "pattern").where(_may())
    return got.groupBy("n", "start", "end").agg(F.max(F.struct("share", "kind"))["kind"].alias("kind"))


def hide(seen: DataFrame, every: int = 5) -> DataFrame:
    """extract()'s rows with each `every`-th base value (by a hash) turned into a token, as if no base pattern had matched it."""
    out = lambda s: F.pmod(F.xxhash64(s["value"], F.lit("hidden")), F.lit(every)) == 0
    moved = F.transform(F.filter("base", out), lambda s: s.withField("kind", F.lit("")))
    return seen.withColumn("truth", F.filter("base", out)).withColumn("tokens", F.concat("tokens", moved)).withColumn("base", F.filter("base", lambda s: ~out(s)))


def recall_of_hidden(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 5) -> DataFrame:
    """(kind, n_hidden, n_found, n_wrong): how many hidden base spans the method finds again under their kind, and how many spans of the
    kind it adds that are none of the hidden ones."""
    seen = hide(extract(docs, id_col, text_col), every)
    found = added_spans(seen, score_patterns(seen.drop("truth"))).withColumn("found", F.lit(True))
    truth = seen.select("n", F.explode("truth").alias("s")).select("n", "s.kind", "s.start", "s.end", F.lit(True).alias("hidden")).distinct()
    both = truth.join(found, ["n", "kind", "start", "end"], "full")
    return both.groupBy("kind").agg(F.count_if("hidden").alias("n_hidden"), F.count_if(F.col("hidden") & F.col("found")).alias("n_found"), F.count_if(F.col("hidden").isNull()).alias("n_wrong"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, spans array<struct<kind, start, end, base>> by kind, then start.

    `base` tells the fixed patterns' spans from those the method adds. Small tables are shuffled, never texts.
    """
    seen = extract(docs, id_col, text_col)
    added = added_spans(seen, score_patterns(seen)).groupBy("n").agg(F.collect_list(F.struct("kind", "start", "end", F.lit(False).alias("base"))).alias("added"))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base")))
    spans = F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean>>")))
    of_kind = lambda k: F.array_sort(F.filter(spans, lambda s: s["kind"] == k))
    return seen.join(added, "n", "left").select(F.col("id").alias(id_col), "n", "key", F.concat(*[of_kind(k) for k in KINDS]).alias("spans"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: lambda s: s["base"] & (s["kind"] == k)
    return found.select(
        id_col,
        *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


_MERGED = "array<struct<start:int,end:int,kind:string>>"


def masked(text: Column, spans: Column) -> Column:
    """The text with <KIND> for each span; overlapping spans become one, under the kind of that which starts first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def join(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (x["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(-1))), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    def put(m: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at(m, i.cast("int"))["end"])
        parts = F.transform(m, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["start"] - before(i)), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text)))

    return let(F.aggregate(ordered, F.array().cast(_MERGED), join), put)


def mask(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs, all rows and columns, with personal data masked in the text; size_col, if there is one, follows.

    Spans are joined to the texts by (id, text hash), broadcast only if they are few.
    """
    found = find(docs, id_col=id_col, text_col=text_col).where(F.size("spans") > 0)
    nulls = F.coalesce(F.col(id_col).cast("string"), F.lit("\0"))
    name, cover = fresh_name(docs), fresh_name(docs, "spans")
    spans = materialise(found.groupBy(F.struct(nulls.alias("id"), F.col("key")).alias(name)).agg(F.first("spans").alias(cover)), "pii-spans")
    few = (spans.agg(F.sum(F.size(cover))).first()[0] or 0) <= MAX_BROADCAST_IDS
    rows = docs.withColumn(name, F.struct(nulls.alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key")))
    got = rows.join(F.broadcast(spans) if few else spans.hint("shuffle_hash"), name, "left")
    text = F.when(F.col(cover).isNull(), F.col(text_col)).otherwise(masked(F.col(text_col), F.col(cover)))
    got = got.withColumn(text_col, text)
    if size_col in docs.columns:
        got = got.withColumn(size_col, F.when(F.col(cover).isNull(), F.col(size_col)).otherwise(F.length(text_col).cast(docs.schema[size_col].dataType)))
    return got.select(*docs.columns)
