"""Domain frames over the driver's tables: catalogue, liked items, profiles, planned queries, hits, signals.

A request is a customer; the items they bought are liked, the brand of their nation's number is a further liked artist,
their market segment a mood, and the first words of what they bought their tags. Parts are the catalogue: name is the
title, brand the artist, type the album and genre. Line items give platform signals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import enrich

#: Artists, genres (moods, tags) and titles that a plan asks for.
MAX_ARTISTS, MAX_TAGS, MAX_TITLES = 6, 4, 3
#: Hits that a request wants of each query, and of each discovery query.
PER_SIGNAL, DISCOVERY_LIMIT = 12, 12
#: The most hits that a search of any type gives.
MOST_HITS = 12
MOODS = ("automobile", "building", "furniture", "household", "machinery")
#: What the catalogue says of an item.
TEXTS = ("title", "artist", "album")
#: How far a discovery search looks past the first hits.
PAST = 3
#: Requests that a partition holds where whole requests are worked on: a few hundred candidates each, of about a KB, and sorted several times.
REQUESTS_AT_ONCE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with what candidates need of each text, made once an item: tokens (t_ columns) and normal forms."""
    texts = {f"t_{c}": X.tokens(F.col(c)) for c in ("title", "artist", "album")}
    return catalogue(spark, sf_dir).withColumns({**texts, "artist_norm": X.norm_artist(F.col("artist")), "album_norm": X.norm_title(F.col("album")), "title_norm": X.norm_title(F.col("title"))})


def liked(spark: SparkSession, sf_dir: str, least_price: float = 0.0) -> DataFrame:
    """(request_id, item_id, pos, title, artist, album): all items of each request, in order of id."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_totalprice") >= least_price).select("o_orderkey", "o_custkey")
    # tables that grow with the input are joined by merge: Spark judges them by their files, and the driver holds what is broadcast
    bought = orders.hint("merge").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    # by item first, where its texts are, then by request, on which all that follows works
    own = bought.select(F.col("o_custkey").alias("request_id"), F.col("l_partkey").alias("item_id")).repartition("item_id").distinct()
    # the texts travel as one column, so that plans that read different ones of them share the shuffle
    own = own.join(catalogue(spark, sf_dir).hint("merge"), "item_id").select("request_id", "item_id", F.array(*TEXTS).alias("texts")).repartition("request_id")
    own = own.withColumn("pos", F.row_number().over(Window.partitionBy("request_id").orderBy("item_id")))
    return own.select("request_id", "item_id", "pos", *[F.get("texts", i).alias(c) for i, c in enumerate(TEXTS)])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, liked_artists, moods): what a request states besides its liked items; little of a customer in debt."""
    c = table(spark, sf_dir, "customer")
    stated = lambda value: F.when(F.col("c_acctbal") >= 0, F.array(value)).otherwise(F.array().cast("array<string>"))
    brand = F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
    return c.select(F.col("c_custkey").alias("request_id"), stated(brand).alias("liked_artists"), stated(F.lower("c_mktsegment")).alias("moods"))


def profiles(spark: SparkSession, sf_dir: str, own: DataFrame | None = None, keep_all: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """One row per request: ordered artists, genres, moods, tags, titles, norm sets, tag and intent tokens, artist weights,
    the words of the whole profile, and has_signal (some liked id, artist or tag token).

    keep_all: requests without a liked item have a row, too. asked: requests in place of the customers', with the columns of
    requests(), and maybe genres and tags (else they follow from the liked items) and others, which are kept.
    """
    asked = requests(spark, sf_dir) if asked is None else asked
    stated = [c for c in ("genres", "tags") if c in asked.columns]
    more = [c for c in asked.columns if c not in ("request_id", "liked_artists", "moods", "genres", "tags")]
    own = liked(spark, sf_dir) if own is None else own
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])
    got = own.groupBy("request_id").agg(ordered("artist").alias("artist_list"), ordered("album").alias("album_list"), ordered("title").alias("title_list"), F.sort_array(F.collect_list("item_id")).alias("liked_ids"))
    got = asked.withColumnsRenamed({c: f"stated_{c}" for c in stated}).hint("merge").join(got, "request_id", "left" if keep_all else "inner")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    got = got.select("request_id", *more, *[none(c, "string") for c in ("liked_artists", "moods", *(f"stated_{c}" for c in stated), "artist_list", "album_list", "title_list")], none("liked_ids", "bigint"))
    # no token goes across a blank, so a list's tokens are those of one joined text; equal texts are looked at once
    joined = lambda c: F.array_join(c, " ")
    words = lambda c: X.tokens(joined(c))
    filled = lambda c, norm: F.array_remove(F.array_distinct(F.transform(F.array_distinct(c), norm)), "")
    got = got.withColumn("credits", F.concat("artist_list", "liked_artists"))
    got = got.select(
        "*",
        F.filter(F.array_distinct("credits"), lambda a: X.norm_artist(a) != "").alias("artists"),
        (X.dedupe_phrases(F.col("stated_genres")) if "genres" in stated else F.slice(X.dedupe_phrases(F.array_distinct("album_list")), 1, MAX_TAGS)).alias("genres"),
        (X.dedupe_phrases(F.col("stated_tags")) if "tags" in stated else F.slice(X.dedupe_phrases(F.array_distinct(F.split(joined("title_list"), " "))), 1, MAX_TAGS)).alias("tags"),
    )
    got = got.withColumn("tag_phrases", X.dedupe_phrases(F.concat("genres", "moods", "tags")))
    # a weight is 1 for each credit of a liked item and .75 for a liked artist
    count = lambda values, n: F.size(F.filter(values, lambda a: a == n))
    weights = lambda all_norms: F.transform("artist_norms", lambda n: count(F.slice(all_norms, 1, F.size("artist_list")), n) + 0.75 * count(F.slice(all_norms, F.size("artist_list") + 1, F.size("liked_artists")), n))
    got = got.withColumn("artist_norms", filled("credits", X.norm_artist)).withColumn("weights", X.let(F.transform("credits", X.norm_artist), weights))
    got = got.withColumns({f"{c}_words": words(c) for c in ("title_list", "artist_list", "artists", "tag_phrases")})
    return got.select(
        "request_id", *more, "liked_ids", "artists", "genres", "moods", "tags", "tag_phrases", "artist_norms", "artist_list", "album_list", "title_list",
        filled("title_list", X.norm_title).alias("title_norms"), filled("album_list", X.norm_title).alias("album_norms"),
        F.array_distinct("title_list_words").alias("title_tokens"), F.array_distinct(F.concat("artist_list_words", words("liked_artists"))).alias("artist_tokens"),
        F.array_distinct("tag_phrases_words").alias("tag_tokens"),
        F.transform("tag_phrases", X.tokens).alias("phrase_tokens"), F.transform("tag_phrases", X.norm_title).alias("tag_norms"),
        F.array_distinct(F.concat("tag_phrases_words", "artists_words", "title_list_words")).alias("intent_terms"),
        F.transform("weights", lambda w: F.least(F.lit(1.0), w / F.array_max("weights"))).alias("artist_weights"),
        # titles; each liked item with title, artist, artists and album; artists; genres, moods and tags
        F.concat("title_list_words", "title_list_words", "artist_list_words", "artist_list_words", words("album_list"), "artists_words", *[words(c) for c in ("genres", "moods", "tags")]).alias("profile_words"),
        F.arrays_overlap(X.raw_tokens(joined(F.concat("title_list", "credits", "genres", "moods", "tags"))), F.array(*map(F.lit, X.VERSION_WORDS))).alias("wants_versions"),
    ).withColumn("has_signal", (F.size("liked_ids") > 0) | (F.size("artist_norms") > 0) | (F.size("tag_tokens") > 0))


def plan(profiles_: DataFrame, per_signal: int = PER_SIGNAL, discovery_limit: int = DISCOVERY_LIMIT) -> DataFrame:
    """(request_id, plan_idx, source_type, query, reliability, limit): labelled queries, the first of each (type, query).

    Blank queries are left out, so a request without a genre, a mood or a tag just has no queries of those.
    """
    per_query = max(1, min(12, per_signal))

    def ask(kind: str, reliability: float, query: Column, limit: int = per_query) -> Column:
        return F.struct(F.lit(kind).alias("source_type"), F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " ")).alias("query"), F.lit(reliability).alias("reliability"), F.lit(limit).alias("limit"))

    def both(a: Column, b: Column) -> Column:
        """Two words of a query, or null if one of them is missing."""
        return F.concat(a, F.lit(" "), b)

    each = lambda c, most, kind, reliability: F.transform(F.slice(c, 1, most), lambda q: ask(kind, reliability, q))
    genre, mood = F.try_element_at("genres", F.lit(1)), F.try_element_at("moods", F.lit(1))
    tag = F.coalesce(F.try_element_at("tags", F.lit(1)), F.try_element_at("tag_phrases", F.lit(1)))
    artists = F.transform(F.slice("artists", 1, MAX_ARTISTS), lambda a: F.array(ask("artist", 0.85, a), ask("artist_context", 0.80, both(a, genre)), ask("artist_context", 0.80, both(a, mood))))
    songs = F.transform(
        F.slice(F.arrays_zip("title_list", "artist_list", "album_list"), 1, MAX_TITLES),
        lambda s: F.array(
            ask("seed_song", 0.78, both(F.nullif(s["title_list"], F.lit("")), F.nullif(s["artist_list"], F.lit("")))),
            ask("seed_album", 0.70, both(F.nullif(s["artist_list"], F.lit("")), F.nullif(album_keyword(s["album_list"]), F.lit("")))),
            ask("title", 0.45, s["title_list"], max(4, min(per_query, 8))),
        ),
    )
    mixed = [
        ask("genre_mood", 0.75, both(genre, mood)),
        ask("tag_combo", 0.72, both(F.try_element_at("tags", F.lit(1)), F.try_element_at("tags", F.lit(2)))),
    ]
    discovery = [both(genre, mood), tag, both(F.try_element_at("artists", F.lit(1)), tag), F.array_join(F.slice("intent_terms", 1, 4), " ")]
    found = F.array(*[ask("discovery", 0.55, q, discovery_limit) for q in discovery]) if discovery_limit > 0 else F.array()
    parts = [F.flatten(artists), each("genres", MAX_TAGS, "genre", 0.75), each("moods", MAX_TAGS, "mood", 0.65), each("tags", MAX_TAGS, "tag", 0.75), F.array(*mixed), F.flatten(songs)]
    queries = F.concat(*parts, found) if discovery_limit > 0 else F.concat(*parts)
    # the first of each (type, query) within the array, a few dozen entries: no shuffle
    numbered = F.filter(F.transform(queries, lambda q, i: F.struct(i.cast("int").alias("plan_idx"), q.alias("q"))), lambda x: x["q"]["query"] != "")
    key = lambda x: F.concat_ws("\n", x["q"]["source_type"], F.lower(x["q"]["query"]))
    first = lambda xs: X.let(F.transform(xs, key), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    got = profiles_.select("request_id", F.explode(X.let(numbered, first)).alias("x"))
    return got.select("request_id", "x.plan_idx", "x.q.*")


def album_keyword(album: Column) -> Column:
    """The first two tokens of an album."""
    return F.array_join(F.slice(X.tokens(album), 1, 2), " ")


def search_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_type, query, item_id, position): what a search of each type and text finds, 0-based, 12 at most, by id.

    Stands in for the search service: each item answers to a bounded number of texts, each text is searched once,
    whoever asks. An item's mood follows from its size.
    """
    mood = F.element_at(F.array(*map(F.lit, MOODS)), (F.col("p_size") % len(MOODS) + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), mood.alias("mood"))
    words = F.array_distinct(F.split("title", " "))
    both = lambda a, b: F.concat(a, F.lit(" "), b)
    one = lambda kind, q: F.array(F.struct(F.lit(kind).alias("source_type"), q.alias("query")))
    each = lambda kind, f: F.transform(words, lambda w: F.struct(F.lit(kind).alias("source_type"), f(w).alias("query")))
    title, artist, album, m = F.col("title"), F.col("artist"), F.col("album"), F.col("mood")
    texts = F.concat(
        one("artist", artist), one("artist_context", both(artist, album)), one("artist_context", both(artist, m)), one("genre", album), one("mood", m),
        each("tag", lambda w: w), one("genre_mood", both(album, m)), one("tag_combo", F.array_join(F.slice(F.split("title", " "), 1, 2), " ")),
        one("seed_song", both(title, artist)), one("seed_album", both(artist, album_keyword(album))), one("title", title),
        one("discovery", both(album, m)), each("discovery", lambda w: w), each("discovery", lambda w: both(F.col("artist"), w)),
    )
    found = parts.select("item_id", F.explode(texts).alias("t")).select("t.source_type", "t.query", "item_id")
    # a filter on the bare row number lets each task cut its lists before the shuffle: a mood's items never meet in one task
    first = found.withColumn("nth", F.row_number().over(Window.partitionBy("source_type", "query").orderBy("item_id"))).where(F.col("nth") <= MOST_HITS + PAST)
    place = F.col("nth") - 1 - F.when(F.col("source_type") == "discovery", PAST).otherwise(0)
    return first.select("source_type", "query", "item_id", place.alias("position")).where(F.col("position").between(0, MOST_HITS - 1))


def found(spark: SparkSession, sf_dir: str, planned: DataFrame | None = None, about: DataFrame | None = None) -> DataFrame:
    """A row per planned query that finds something; item_id, position and the columns of about (item_id, ...) are arrays over its hits.

    So the hits of a search travel as one row, next to the equal rows of other requests. Planned queries and lists are never broadcast:
    by the size of the files that they come from they look small, in memory they are many times that.
    """
    planned = plan(profiles(spark, sf_dir)) if planned is None else planned
    lists = search_lists(spark, sf_dir)
    lists = lists if about is None else lists.hint("merge").join(about, "item_id")
    fields = [c for c in lists.columns if c not in ("source_type", "query", "position")]
    lists = lists.groupBy("source_type", "query").agg(F.array_sort(F.collect_list(F.struct("position", *fields))).alias("hits"))
    lists = lists.select("source_type", "query", *[F.col("hits")[c].alias(c) for c in ("position", *fields)])
    return planned.hint("merge").join(lists, ["source_type", "query"])


def as_found(hits_: DataFrame) -> DataFrame:
    """Hits of another channel in the form of found(): a row each, with arrays of one entry, and no limit but their own number."""
    kept = ("request_id", "plan_idx", "source_type", "query", "reliability")
    return hits_.select(*kept, (F.col("position") + 1).cast("int").alias("limit"), *[F.array(c).alias(c) for c in hits_.columns if c not in kept])


def n_requests(spark: SparkSession, sf_dir: str, profiles_: DataFrame | None = None) -> int:
    """How many requests there are at most: profiles, where they are at hand as a table, else customers. A count of either reads no rows, only footers of files."""
    return (table(spark, sf_dir, "customer") if profiles_ is None else profiles_).count()


def by_request(rows: DataFrame, n: int) -> DataFrame:
    """Rows (such as found()'s) of n requests dealt by request, REQUESTS_AT_ONCE of them to a partition at most, on average.

    The number of partitions is given, or Spark would merge them by the size of what is shuffled, of which each row stands for a dozen
    hits, and sort more than a task's memory holds.
    """
    return rows.repartition(max(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / REQUESTS_AT_ONCE)), "request_id")


def each_hit(found_: DataFrame) -> DataFrame:
    """A row per hit of found()'s rows, within the limit of its query, with the query's tokens; recall's hits have none."""
    more = [c for c in found_.columns if c not in ("request_id", "plan_idx", "source_type", "query", "reliability", "limit", "item_id", "position")]
    none = F.array().cast("array<string>")
    rows = found_.withColumn("query_tokens", F.when(F.col("source_type") == "embedding", none).otherwise(X.tokens(F.col("query"))))
    rows = rows.select("request_id", "plan_idx", "source_type", "query", "query_tokens", "reliability", "limit", "item_id", *more, F.posexplode("position").alias("_nth", "position")).where("position < `limit`")
    at = lambda c: F.get(c, F.col("_nth")).alias(c)
    return rows.select("request_id", "plan_idx", "source_type", "query", "query_tokens", "reliability", at("item_id"), "position", *map(at, more))


def hits(spark: SparkSession, sf_dir: str, planned: DataFrame | None = None) -> DataFrame:
    """Search hits of the planned queries, with 0-based positions."""
    return each_hit(found(spark, sf_dir, planned))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform signals by item; items without line items have none. The audio grade follows from discount and quantity."""
    lines = table(spark, sf_dir, "lineitem")
    got = lines.groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.count("*").alias("comments"),
        F.count_distinct("l_suppkey").alias("hot"),
        F.sum("l_quantity").cast("long").alias("red"),
        (F.count("*") * 5).alias("followers"),
        (F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) * 2 <= F.count("*")).alias("playable"),
        F.max("l_discount").alias("max_discount"),
    )
    level = F.when(F.col("max_discount") >= 0.1, "lossless").when(F.col("max_discount") >= 0.09, "medium")
    return got.withColumn("audio", enrich.audio_grade(level, F.col("red") * 1000)).drop("max_discount")
