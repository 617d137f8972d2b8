"""Queries over the driver's tables, by name; their DuckDB SQL is in oracles.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import requests, shown
from tessera.functions import scoring as S
from tessera.functions import text as X
from tessera.operators import catalog, enrich, explain, filters, learning, metrics, rerank, retrieval, semantic, store, tables, versions
from tessera.plans import domain, evaluate, response
from tessera.plans import recommend as R
from tessera.sources import cache

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _six(c):
    """Six places; the addend settles values that are ties after an earlier rounding to nine, which engines round differently."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-10, 6)


def _r(c: str):
    return _six(c).alias(c)


def _join(c):
    return F.array_join(c, ",")


# catalogue


@query
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    ask = spark.sql("SELECT 'a' AS query_id, 'red widget 17' AS query UNION ALL SELECT 'b', 'Brand#12 economy' UNION ALL SELECT 'c', 'the standard brand 17'")
    return catalog.search(domain.catalogue(spark, sf), ask).select("query_id", "item_id", "title", "artist", "score", "rank")


@query
def catalog_confidence(spark: SparkSession, sf: str) -> DataFrame:
    p = domain.table(spark, sf, "part")
    source = F.when(F.col("p_size") % 3 == 0, "internal").otherwise("netease+lastfm")
    song = F.when(F.col("p_size") % 5 != 0, F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("item_id"), catalog.display_mode(source, song, F.col("p_size") / 50).alias("display"))


@query
def catalog_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Ids beyond the catalogue, the first of which a fallback knows; blank artists are dropped."""
    items = domain.catalogue(spark, sf).withColumn("source", F.lit("catalogue")).withColumn("artist", F.when(F.col("artist") == "Brand#7", " ").otherwise(F.col("artist")))
    top = domain.table(spark, sf, "part").agg(F.max("p_partkey").alias("top"))
    fallback = top.select((F.col("top") + 1).alias("item_id"), F.lit("late").alias("title"), F.lit("x").alias("artist"), F.lit("").alias("album"), F.lit("netease").alias("source"))
    ids = domain.table(spark, sf, "lineitem").select((F.col("l_partkey") + F.col("l_linenumber")).alias("item_id")).distinct()
    return catalog.enrich(ids, items, fallback).select("item_id", "title", "artist", "album", "source", "display")


@query
def catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = domain.table(spark, sf, "lineitem").select((F.col("l_partkey") + F.col("l_linenumber")).alias("item_id")).distinct()
    return catalog.lookup(domain.catalogue(spark, sf), ids)


@query
def search_hits_shape(spark: SparkSession, sf: str) -> DataFrame:
    p = domain.table(spark, sf, "part")
    raw = p.select(F.when(F.col("p_size") > 40, F.lit("n/a")).otherwise(F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("artist"), F.array("p_brand").alias("artists"), F.col("p_type").alias("album"), F.lit(None).cast("string").alias("cover_url"), F.col("p_partkey").alias("row"))
    shaped = catalog.search_hit(raw, "https://example.org/song?id=")
    return shaped.select("item_id", "title", "artist", _join(F.col("artists")).alias("artists"), "album", "cover_url", "url")


# text


@query
def tokenize_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = domain.table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"), X.raw_tokens(F.col("text")).alias("raw"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.size("raw").cast("long").alias("n_raw"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query
def normalize_titles(spark: SparkSession, sf: str) -> DataFrame:
    p = domain.table(spark, sf, "part")
    title = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" (Live at "), "p_type", F.lit(")"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("["), "p_name", F.lit("] x"))).otherwise(F.concat("p_name", F.lit(" - Acoustic Version")))
    return p.select(F.col("p_partkey").alias("item_id"), X.norm_title(title).alias("norm_title"), X.norm_artist(F.col("p_brand")).alias("norm_artist"), X.has_version_word(title).alias("version"))


@query
def dedupe_phrases(spark: SparkSession, sf: str) -> DataFrame:
    p = domain.profiles(spark, sf)
    phrases = F.concat("artists", F.transform("artists", F.upper), "genres", F.array(F.lit("r&b"), F.lit(" ")))
    return p.select("request_id", _join(X.dedupe_phrases(phrases)).alias("phrases"), _join(X.dedupe_keep_order(phrases)).alias("kept"))


@query
def contains_phrase(spark: SparkSession, sf: str) -> DataFrame:
    a = domain.catalogue(spark, sf)
    words = F.array(F.lit("red"), F.lit("widget"))
    t = X.raw_tokens(F.col("title"))
    return a.select("item_id", X.contains_phrase(t, words).alias("has"), X.starts_with(t, F.slice(t, 1, 1)).alias("starts"), _join(X.without(t, F.array(F.lit("red")))).alias("rest"))


@query
def jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = domain.catalogue(spark, sf).select("item_id", F.array_union(X.tokens(F.col("title")), X.tokens(F.col("album"))).alias("t"))
    q = p.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return p.join(q, "item_id").select("item_id", _six(X.jaccard(F.col("t"), F.col("u"))).alias("jaccard"), _six(X.coverage(F.col("t"), F.col("u"))).alias("coverage"))


@query
def strip_tag_terms(spark: SparkSession, sf: str) -> DataFrame:
    a = domain.catalogue(spark, sf)
    tags = F.when(F.col("album") == "SMALL", F.array().cast("array<string>")).otherwise(F.array(F.lit("red"), F.lit("ring")))
    return a.select("item_id", X.strip_tag_terms(F.col("title"), tags).alias("rest"), X.joined_text(F.col("title"), F.col("artist"), F.col("album")).alias("whole"))


@query
def text_for_embedding(spark: SparkSession, sf: str) -> DataFrame:
    a = domain.catalogue(spark, sf)
    return a.select("item_id", store.text_for_embedding(F.col("title"), F.concat(F.lit(" "), F.col("artist")), F.when(F.col("album") != "SMALL", F.col("album")).otherwise(" "), F.lit("genre")).alias("text"))


@query
def coerced_lists(spark: SparkSession, sf: str) -> DataFrame:
    e = domain.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    texts = F.array(F.concat(F.lit(" "), F.col("event_type")), F.upper("event_type"), F.lit(None).cast("string"), k, F.lit(" "))
    return e.select("event_id", _join(X.string_list(texts, 2)).alias("texts"), _join(X.int_list(F.array(k, F.lit("x"), F.lit("0"), k, F.lit("7"), F.lit("8")), 2)).alias("numbers"))


@query
def lenient_casts(spark: SparkSession, sf: str) -> DataFrame:
    e = domain.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("x1")).otherwise(F.get_json_object("props", "$.k"))
    props = F.when(F.col("event_id") % 3 == 0, F.lit("{bad")).when(F.col("event_id") % 3 == 1, F.col("props"))
    return e.select(
        "event_id", X.maybe_int(raw).alias("k"), _six(X.clip01(X.maybe_float(raw) / 50)).alias("share"), F.size(X.json_list(F.when(F.col("event_id") % 2 == 0, F.lit('["a", "b"]')).otherwise(F.col("props")))).cast("long").alias("n_list"),
        X.json_object(props, "k long")["k"].alias("object_k"),
    )


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, body): a request's JSON text for each event: broken, nested, too long, of wrong kinds, and right."""
    e = domain.table(spark, sf, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k"), F.lit("1")))
    said = lambda text: F.replace(F.replace(F.lit(text), F.lit("<k>"), F.col("k")), F.lit("<t>"), F.col("event_type"))
    texts = (
        '{"liked_songs": [', '{"liked_songs":[{"netease_song_id":"<k>","title":" T<k> ","artists":["<t>",""," b "],"deep":{"x":[1]}},{"netease_song_id":<k>},"x",{"netease_song_id":0}],"k":"<k>"}',
        '{"liked_artists":[" <t> ","<t>",null,<k>],"excluded_song_ids":[<k>,"<k>",0,"x",7],"novelty":<k>}', '{"genres":"<t>"}', '{"novelty":"high","k":3}', '{"n":<k>,"content_weight":"0.25","tags":["t<k>"],"k":null}', "[<k>]", '{"n":<k>}',
    )
    many = F.concat(F.lit('{"tags":['), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit('"t'), (i % 40).cast("string"), F.lit('"'))), ","), F.lit("]}"))
    kind = F.col("event_id") % 9
    body = many
    for i, text in enumerate(texts):
        body = F.when(kind == i, said(text)).otherwise(body)
    return e.select("event_id", body.alias("body"))


@query
def coerced_requests(spark: SparkSession, sf: str) -> DataFrame:
    got = _bodies(spark, sf).select("event_id", requests.coerce(F.col("body")).alias("q")).select("event_id", "q.*")
    songs = _join(F.transform("liked_songs", lambda x: F.concat_ws("/", x["item_id"], x["title"], F.array_join(x["artists"], "+"))))
    return got.select("event_id", "error", songs.alias("songs"), *[_join(F.col(c)).alias(c) for c in ("liked_artists", "genres", "tags")], _join(F.col("excluded_song_ids").cast("array<string>")).alias("excluded"), "content_weight", "novelty", "k")


# semantic recall


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return domain.table(spark, sf, "conversations").select(F.col("conv_id").alias("corpus"), F.col("turn").alias("doc"), X.tokens(F.col("text")).alias("tokens"))


@query
def tfidf_norms(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.norms(semantic.tfidf(_turns(spark, sf))).select("corpus", "doc", _r("norm"), "n_terms")


@query
def tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.cosine_to(semantic.tfidf(_turns(spark, sf)), F.col("doc") == 0).select("corpus", "doc", _r("cosine"))


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The queries are every vector whose id is divisible by 20, against all vectors."""
    e = domain.table(spark, sf, "embeddings")
    items = e.select(F.col("vec_id").alias("item_id"), semantic.l2_normalise(F.col("embedding")).alias("v"))
    return items.where(F.col("item_id") % 20 == 0).withColumnRenamed("item_id", "query_id"), items


@query
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.vector_topk(*_vectors(spark, sf), k=30).select("query_id", "item_id", _r("score"), "rank")


@query
def vector_topk_excluding(spark: SparkSession, sf: str) -> DataFrame:
    e = domain.table(spark, sf, "embeddings").select("vec_id", "label")
    own = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "label").join(e, "label").select("query_id", F.col("vec_id").alias("item_id"))
    return semantic.vector_topk(*_vectors(spark, sf), k=30, excluded=own).select("query_id", "item_id", _r("score"), "rank")


@query
def semantic_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Each profile's text against the index of the catalogue's texts; liked items are dropped after the cut."""
    found = R.recalled(spark, sf, domain.profiles(spark, sf))
    return found.select("request_id", "item_id", F.col("position").alias("rank"))


@query
def lexical_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The same recall by the TF-IDF vectors themselves."""
    found = R.recalled(spark, sf, domain.profiles(spark, sf), dimensions=0)
    return found.select("request_id", "item_id", F.col("position").alias("rank"), "reliability", "source_type")


# profiles and retrieval


@query
def profile_artist_weights(spark: SparkSession, sf: str) -> DataFrame:
    p = domain.profiles(spark, sf).select("request_id", F.explode(F.arrays_zip("artist_norms", "artist_weights")).alias("w"))
    return p.select("request_id", F.col("w.artist_norms").alias("artist_norm"), _six("w.artist_weights").alias("weight"))


@query
def profile_features(spark: SparkSession, sf: str) -> DataFrame:
    p = domain.profiles(spark, sf)
    lists = [_join(F.col(c)).alias(c) for c in ("artists", "genres", "moods", "tags", "tag_phrases", "tag_tokens", "intent_terms")]
    return p.select("request_id", F.size("liked_ids").cast("long").alias("n_liked"), *lists, _join(F.array_sort("title_tokens")).alias("title_tokens"), F.md5(F.array_join(F.array_sort("profile_words"), " ")).alias("words_md5"), "wants_versions")


@query
def profile_echo(spark: SparkSession, sf: str) -> DataFrame:
    return response.profile_echo(domain.profiles(spark, sf)).select("request_id", *[_join(F.col(c)).alias(c) for c in response.ECHO])


@query
def control_echo(spark: SparkSession, sf: str) -> DataFrame:
    c = domain.table(spark, sf, "customer")
    asked = c.select(F.col("c_custkey").alias("request_id"), (F.col("c_acctbal") / 5000).alias("content_weight"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey") / 20).alias("novelty"), F.lit(0.3).alias("diversity"), (F.col("c_nationkey") * 3 - 5).alias("k"))
    return response.control_echo(asked).select("request_id", _r("content_weight"), _r("novelty"), _r("diversity"), "k")


@query
def no_input_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose only liked items are of large orders; of those without any signal nothing is planned."""
    p = domain.profiles(spark, sf, domain.liked(spark, sf, 450_000.0), keep_all=True)
    planned = domain.plan(p.where("has_signal")).groupBy("request_id").agg(F.count("*").alias("n_queries"))
    return p.select("request_id", "has_signal", F.when(~F.col("has_signal"), "no_input").alias("fallback")).join(planned, "request_id", "left").fillna(0, ["n_queries"])


@query
def plan_queries(spark: SparkSession, sf: str) -> DataFrame:
    return domain.plan(domain.profiles(spark, sf)).select("request_id", "plan_idx", "source_type", "query", "reliability", F.col("limit").alias("max_hits"))


@query
def merge_hits(spark: SparkSession, sf: str) -> DataFrame:
    m = retrieval.merge_hits(domain.each_hit(domain.by_request(domain.found(spark, sf), domain.n_requests(spark, sf))), together=True)
    return m.select("request_id", "item_id", "n_hits", "n_names", _join(F.col("types")).alias("types"), F.array_join("sources", "; ").alias("sources"), F.col("first_hit.plan_idx").alias("first_plan"), _r("best_value"), _r("mean_value"), _r("mean_position"))


def _cached(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over one cache of searches: requests in debt, then all. Hits of the second, and the counters of both."""
    lists = domain.search_lists(spark, sf).where("source_type IN ('artist', 'genre', 'mood', 'tag')")
    # written once: both runs ask for them
    planned = tables.written(domain.plan(domain.profiles(spark, sf)).where("source_type <> 'discovery'").select("request_id", "query", "limit"), "planned")
    debt = domain.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("request_id"))

    def look_up(missing: DataFrame) -> DataFrame:
        return missing.join(lists, "query").where("position < `limit`").select("query", "limit", "position", "item_id", F.lit(None).cast("string").alias("error"))

    folder = tables.fresh_folder(spark, "cache")
    cache.search(planned.join(debt, "request_id", "left_semi"), folder, look_up, "first")
    return cache.search(planned, folder, look_up, "second"), cache.counters(spark, folder)


@query
def cached_search(spark: SparkSession, sf: str) -> DataFrame:
    return _cached(spark, sf)[0].withColumnRenamed("limit", "max_hits")


@query
def cache_counters(spark: SparkSession, sf: str) -> DataFrame:
    return _cached(spark, sf)[1]


@query
def route_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with the same search count together, so that the hits of each are not made."""
    searches = domain.plan(domain.profiles(spark, sf)).groupBy("source_type", "query", "limit").agg(F.count("*").alias("n_requests"))
    found = searches.join(domain.search_lists(spark, sf), ["source_type", "query"]).where("position < `limit`")
    return retrieval.route_counts(found, "n_requests")


def _both_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of both channels: hits are shuffled once, as rows of searches."""
    profiles = tables.written(domain.profiles(spark, sf), "profiles")
    found, more = domain.found(spark, sf, domain.plan(profiles.where("has_signal"))), R.recalled(spark, sf, profiles, dimensions=0)
    if more is not None:
        found = retrieval.merge_channels(found, domain.as_found(more.drop("query_tokens")).select(found.columns))
    return retrieval.merge_hits(domain.each_hit(domain.by_request(found, domain.n_requests(spark, sf, profiles))), together=True)


@query
def merge_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of items as several searches tell them, each with gaps: the first that is not empty, in order of the searches."""
    found = domain.found(spark, sf, about=domain.catalogue(spark, sf).hint("merge"))
    h = domain.each_hit(domain.by_request(found, domain.n_requests(spark, sf)))
    gap = lambda c, n: F.when((F.col("plan_idx") + F.col("position")) % n != 0, F.concat(F.col(c), F.lit(" "), F.col("source_type"))).otherwise("")
    h = h.withColumns({"title": gap("title", 2), "artist": gap("artist", 3), "album": gap("album", 5), "artists": F.when(F.col("plan_idx") % 4 == 1, F.array("source_type")).otherwise(F.array().cast("array<string>"))})
    return retrieval.merge_tracks(h).select("request_id", "item_id", "title", "artist", "album", _join(F.col("artists")).alias("artists"))


@query
def merge_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates and hits of each request, and the items that recall adds to those of searches."""
    both = _both_channels(spark, sf)
    new = F.count_if(F.size(F.array_remove("types", "embedding")) == 0)
    return both.groupBy("request_id").agg(F.count("*").alias("n_candidates"), F.sum("n_hits").alias("n_hits"), new.alias("n_added"))


# scores


def _scored(spark: SparkSession, sf: str, profiles: DataFrame | None = None, needs: tuple[str, ...] | None = None) -> DataFrame:
    profiles = tables.written(domain.profiles(spark, sf), "profiles") if profiles is None else profiles
    return R.scored(R.enriched(spark, sf, profiles), profiles, needs)


def _score_query(name: str, columns: list[str], whole: bool):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _scored(spark, sf, needs=()) if whole else R.features(R.candidates(spark, sf))
        return rows.select("request_id", "item_id", *[F.round(F.col(c) + 1e-10, 8).alias(c) for c in columns])

    run.__name__ = name
    query(run)


SCORE_QUERIES = {
    "retrieval_confidence": ["metadata", "confidence"],
    "multi_source_agreement": ["agreement"],
    "artist_match": ["artist_match", "known_artist"],
    "artist_affinity": ["affinity"],
    "tag_match": ["tag_match", "title_overlap"],
    "title_match": ["title_match"],
    "novelty": ["novelty", "seed_album"],
    "final_score": ["content", "retrieval", "quality", "base", "gate", "score"],
}
for _name, _columns in SCORE_QUERIES.items():
    _score_query(_name, _columns, _name == "final_score")


@query
def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, needs=()).select("request_id", "item_id", _r("text_similarity"))


@query
def signal_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = enrich.attach(domain.catalogue(spark, sf), domain.signals(spark, sf))
    c = F.col
    return s.select("item_id", "enriched", _six(S.popularity(c("comments"), c("hot"), c("red"), c("enriched"))).alias("popularity"), _six(S.authority(c("followers"), c("enriched"))).alias("authority"), S.playable(c("playable"), c("enriched")).alias("play"), _six(S.audio_quality(c("audio"))).alias("audio"))


@query
def audio_grades(spark: SparkSession, sf: str) -> DataFrame:
    p = domain.table(spark, sf, "part")
    levels = F.array(*[F.lit(x) for x in ("hires", "jyeffect", "lossless", "exhigh", "higher", "standard", "medium", "low", "odd", "")])
    rate = F.when(F.col("p_size") % 4 != 0, (F.col("p_retailprice") * 700).cast("long") - 600_000)
    return p.select(F.col("p_partkey").alias("item_id"), enrich.audio_grade(F.element_at(levels, (F.col("p_size") % 10 + 1).cast("int")), rate).alias("grade"))


@query
def signal_payload(spark: SparkSession, sf: str) -> DataFrame:
    s = domain.signals(spark, sf)
    kept = enrich.to_payload(s, ["comments", "followers", "playable"])
    return enrich.from_payload(kept, "comments long, followers long, playable boolean, hot long")


@query
def trust_score(spark: SparkSession, sf: str) -> DataFrame:
    return R.parts(R.enriched(spark, sf)).select("request_id", "item_id", _r("trust"))


def _ranked(spark: SparkSession, sf: str, k: int = 10, profiles: DataFrame | None = None, needs: tuple[str, ...] | None = None) -> DataFrame:
    return _scored(spark, sf, profiles, needs).withColumn("rank", R.by_score()).where(F.col("rank") <= k)


@query
def score_order(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, needs=("title",)).select("request_id", "rank", "item_id", _r("score"))


@query
def enrich_budget(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.within_budget(_scored(spark, sf, needs=("title",)), 10).groupBy("request_id").agg(F.count("*").alias("n"), F.max("place").alias("last"), _six(F.min("score")).alias("least"))


# filters


def _filter_query(name: str, bad):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = R.enriched(spark, sf) if bad is filters.unplayable else R.candidates(spark, sf)
        return rows.withColumn("_bad", bad()).where("_bad").select("request_id", "item_id")

    run.__name__ = name
    query(run)


for _name, _bad in (("filter_liked", filters.liked_or_excluded), ("filter_title_variant", filters.liked_title_variant), ("filter_unplayable", filters.unplayable), ("dedup_versions", filters.duplicate_version)):
    _filter_query(_name, _bad)


@query
def filter_tag_title(spark: SparkSession, sf: str) -> DataFrame:
    c = R.candidates(spark, sf)
    title = F.when(F.col("item_id") % 11 == 0, F.col("album")).when(F.col("item_id") % 11 == 1, F.concat(F.col("genres")[0], F.lit(" nights"))).otherwise(F.col("title"))
    album = F.when(F.col("item_id") % 11 == 1, "x9").otherwise(F.col("album"))
    return c.withColumn("title", title).withColumn("album", album).withColumn("_bad", filters.tag_title()).where("_bad").select("request_id", "item_id")


@query
def filter_missing(spark: SparkSession, sf: str) -> DataFrame:
    c = R.candidates(spark, sf).withColumn("artist", F.when(F.col("item_id") % 7 == 0, "  ").otherwise(F.col("artist")))
    return c.withColumn("_bad", filters.missing_metadata()).groupBy("request_id").agg(F.sum(F.when(F.col("_bad"), 1).otherwise(0)).alias("dropped"), F.count("*").alias("n"))


@query
def filter_low_trust(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = R.parts(R.enriched(spark, sf).withColumn("comments", F.col("comments") % 12).withColumn("followers", F.col("comments") * 5))
    return rows.where(filters.low_trust(c("agreement"), c("confidence"), c("popularity"), c("authority"), c("enriched"))).select("request_id", "item_id")


def _steps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hits of both channels (recall by TF-IDF vectors), candidates after the first rules, and after those that need signals."""
    profiles = tables.written(domain.profiles(spark, sf), "profiles")
    more = R.recalled(spark, sf, profiles, dimensions=0)
    more = None if more is None else tables.written(more, "recalled")
    hits = R.with_recall(domain.hits(spark, sf, domain.plan(profiles.where("has_signal"))), more)
    before = R.filtered(R.candidates(spark, sf, profiles, more=more))
    return hits, before, R.with_signals(R.first_round(before, profiles), domain.signals(spark, sf), n=domain.n_requests(spark, sf, profiles))


@query
def filter_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of both channels by the rule that drops them: the five without signals, then the two that need them."""
    _, before, after = _steps(spark, sf)
    return filters.funnel(before.where("dropped IS NOT NULL").select("dropped").unionByName(after.select("dropped")))


@query
def funnel_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of each request, rules in their order, a rule seeing what those before it have left."""
    return response.funnel(*_steps(spark, sf))


@query
def pool_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The pool that cards are chosen from: scores of the second round, on what all rules keep."""
    _, _, after = _steps(spark, sf)
    return R.totals(R.with_text(after, vectors=False)).select("request_id", "item_id", "place", "enriched", _r("text_similarity"), _r("content"), _r("score"))


# lists


#: What the metrics of lists read of a card, beside its scores.
LISTED = ("title", "artist_norm", "album_norm", "title_norm", "types", "popularity")


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, needs=LISTED).withColumn("title_set", X.token_set(F.col("title")))


@query
def artist_cap(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.cap(_scored(spark, sf, needs=("title", "artist_norm")), "artist_norm", rerank.caps(10)[0]).select("request_id", "item_id", _r("score"))


@query
def pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    parts = ("artist_norm", "album_norm", "taste_tokens", "text_codes", "text_weights")
    got = rerank.pairs_of_lists(_ranked(spark, sf, needs=("title", *parts)), [*parts], rerank.pair_similarity)
    return got.select("request_id", F.explode("pairs").alias("p")).select("request_id", "p.rank_a", "p.rank_b", _six("p.value").alias("similarity"))


@query
def matched_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.candidates(spark, sf).withColumn("have", F.concat("t_artist", "t_album"))
    return rows.select("request_id", "item_id", _join(explain.matched_tags(F.col("tag_phrases"), F.col("phrase_tokens"), F.col("have"))).alias("tags"))


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of the score order; the last two places of a list count as promoted."""
    profiles = tables.written(domain.profiles(spark, sf), "profiles")
    return R.cards(_ranked(spark, sf, profiles=profiles), F.col("rank") > 8, profiles)


@query
def pick_types(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(spark, sf).select("request_id", "item_id", "pick", F.array_join("reasons", "; ").alias("reasons"), "explanation")


@query
def cards(spark: SparkSession, sf: str) -> DataFrame:
    """The cards' texts, and their breakdown as columns."""
    c = response.card(_shown(spark, sf).withColumn("rank_score", F.col("score")), "https://example.org/song?id=")
    lists = [F.array_join(x, "; ").alias(x) for x in ("sources", "source_types", "matched_tags")]
    return c.select("request_id", "rank", "item_id", "title", "artist", "album", "url", "pick_type", *lists, *[_six(f"score_breakdown.{x}").alias(x) for x in response.BREAKDOWN])


@query
def card_chips(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    got = shown.chips(c("reasons"), c("artist_match"), c("tags"), c("tag_match"), c("sources"), c("agreement"), c("pick"), c("novelty"))
    return _shown(spark, sf).select("request_id", "item_id", _join(got).alias("chips"))


@query
def shown_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Lists, addresses, durations and presets as a page shows them."""
    p = domain.table(spark, sf, "part")
    raw = F.concat(F.lit(" , "), F.replace("p_name", F.lit(" "), F.lit(" ,")), F.lit(", "), F.col("p_brand"))
    url = F.when(F.col("p_size") % 3 == 0, "HTTP://example.org/a?u=http://b").when(F.col("p_size") % 3 == 1, "https://example.org")
    ms = F.when(F.col("p_size") > 5, (F.col("p_retailprice") * 300).cast("long")).when(F.col("p_size") > 2, F.lit(0))
    preset = F.element_at(F.array(*map(F.lit, ("safe", "balanced", "discovery", "none"))), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("item_id"), _join(shown.parse_csv(raw)).alias("parts"), shown.https(url).alias("url"), shown.duration(ms).alias("duration"), shown.sliders(preset)["diversity"].alias("diversity"))


@query
def recommend_mmr(spark: SparkSession, sf: str) -> DataFrame:
    got = R.recommend(spark, sf)
    return got.select("request_id", "rank", "item_id", "title", "artist", "album", _r("score"), _r("rank_score"), "promoted", "pick", F.array_join("reasons", "; ").alias("reasons"), "explanation")


# store, feedback, learning


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "like", "click", "click", "signup", "why_clicked", "error", "dislike", "view", "impression")])
    return domain.table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("request_id"), F.get_json_object("props", "$.k").cast("long").alias("item_id"), kind[F.col("event_type")].alias("event_type"), "value")


@query
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """What the first searches of a plan have found, then what the later ones and an embedding channel find."""
    h = domain.hits(spark, sf)
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    quality = lambda rows: rows.groupBy("item_id").agg(_six(F.max("reliability")).alias("quality"))
    first = h.where("source_type IN ('artist', 'genre')")
    later = h.where("source_type IN ('tag', 'title')").unionByName(h.where("source_type = 'mood'").withColumn("source_type", F.lit("embedding")))
    old, new = (store.observed(rows, quality(rows.where("source_type <> 'embedding'")), day(at)) for rows, at in ((first, "2024-01-01 00:00:00"), (later, "2024-01-02 00:00:00")))
    got = store.upsert(old, new)
    return got.select("item_id", "seen", "first_seen", "last_seen", "quality", F.array_join(F.array_sort("query_texts"), "; ").alias("query_texts"), _join(F.array_sort("source_types")).alias("source_types"), F.size("tags").cast("long").alias("n_tags"), "duration_ms")


@query
def feedback_read(spark: SparkSession, sf: str) -> DataFrame:
    """The events of requests in debt, in order of time."""
    ids = domain.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("request_id"))
    items = _feedback(spark, sf).select("request_id", "item_id", F.lit(1).alias("rank"))
    _, events = store.read_feedback(items, _feedback(spark, sf), ids)
    return events.select("request_id", "event_id", "event_type", "place")


@query
def record_casts(spark: SparkSession, sf: str) -> DataFrame:
    e = domain.table(spark, sf, "events")
    raw = e.select(F.col("event_id").cast("string").alias("item_id"), F.when(F.col("event_id") % 5 != 0, F.get_json_object("props", "$.k")).otherwise("bad").alias("hot"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 3 - 1).cast("string")).alias("playable"), F.when(F.col("event_id") % 2 == 0, F.lit('["x", "y"]')).otherwise("[bad").alias("artists"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("title"))
    got = store.as_record(raw, {"item_id": "bigint", "hot": "bigint", "playable": "boolean", "artists": "array<string>", "title": "string"})
    track = store.as_track(got.withColumn("album", F.lit("")).withColumn("cover_url", F.lit(""))).select("item_id", "artist")
    return got.join(track, "item_id").select("item_id", "hot", "playable", _join(F.col("artists")).alias("artists"), "title", "artist")


@query
def write_health(spark: SparkSession, sf: str) -> DataFrame:
    raw = domain.table(spark, sf, "events").withColumn("event_type", F.concat(F.lit(" "), F.upper("event_type")))
    return store.write_health(*store.validate(raw))


@query
def feedback_latest(spark: SparkSession, sf: str) -> DataFrame:
    return store.latest(_feedback(spark, sf), ["request_id"], ["ts", "event_id"]).select("request_id", "event_id", "event_type")


@query
def feedback_valid(spark: SparkSession, sf: str) -> DataFrame:
    raw = domain.table(spark, sf, "events").withColumn("event_type", F.concat(F.lit(" "), F.upper("event_type")))
    good, bad = store.validate(raw)
    return good.select("event_id", F.lit("accepted").alias("state")).unionByName(bad.select("event_id", F.lit("quarantined").alias("state")))


@query
def weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    return learning.weak_labels(_feedback(spark, sf))


@query
def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    return learning.summary(learning.weak_labels(_feedback(spark, sf)))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """A sample for each exposed card, with its features, its label and the request's controls."""
    shown = _shown(spark, sf).withColumn("rank_score", F.col("score"))
    log = store.exposures(shown).withColumns({"content_weight": F.lit(R.CONTENT_WEIGHT), "novelty_weight": F.lit(R.NOVELTY_WEIGHT), "diversity": F.lit(R.DIVERSITY)})
    return learning.training_data(log, _feedback(spark, sf))


@query
def exposure_log(spark: SparkSession, sf: str) -> DataFrame:
    got = store.exposures(_shown(spark, sf).withColumn("rank_score", F.col("score")))
    return got.select("request_id", "item_id", "rank", _r("score"), _r("rank_score"), _r("quality"), _join(F.col("types")).alias("types"), F.size("reasons").cast("long").alias("n_reasons"), "pick", "was_impressed")


@query
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).select("request_id", "item_id", "binary", "weight", "kind", *[_r(c) for c in learning.BASE_FEATURES])


@query
def feature_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the features of cards with popularity and without authority."""
    rows = learning.extract(R.parts(R.enriched(spark, sf)).select("request_id", "item_id", "types", "popularity", F.lit(None).cast("double").alias("authority")))
    return spark.createDataFrame(list(enumerate(learning.schema(rows))), "place long, feature string")


@query
def train_ranker(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = tables.written(_samples(spark, sf), "samples"), list(learning.BASE_FEATURES)
    model, reason = learning.train(rows, names)
    if model is None:
        return rows.select("request_id", "item_id", F.lit(None).cast("double").alias("learned_score"))
    return learning.predict(model, rows, names).select("request_id", "item_id", "learned_score")


@query
def train_auc(spark: SparkSession, sf: str) -> DataFrame:
    """How well the final score tells the samples with a positive event from the others: ties count half."""
    return learning.auc(_samples(spark, sf), "f_score").select("n_positive", "n_negative", _r("auc"))


@query
def ranker_gradient(spark: SparkSession, sf: str) -> DataFrame:
    """The objective's gradient at the trained ranker's coefficients: 0 at the optimum, by feature."""
    rows, names = tables.written(_samples(spark, sf), "samples"), list(learning.BASE_FEATURES)
    model, _ = learning.train(rows, names)
    if model is None:
        return spark.createDataFrame([(n, 0.0) for n in ("intercept", *names)], "feature string, gradient double")
    return learning.gradient(model, rows, names).select("feature", (F.round("gradient", 4) + 0.0).alias("gradient"))


def _shadow(spark: SparkSession, sf: str) -> DataFrame:
    """Cards with a learned score, but for the lists of requests in debt."""
    debt = domain.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("request_id"), F.lit(True).alias("debt"))
    rows = _cards(spark, sf).join(debt.hint("merge"), "request_id", "left").withColumn("learned_score", F.when(F.col("debt").isNull(), F.round(F.col("novelty") * 0.7 + F.col("popularity") * 0.3, 9)))
    return learning.shadow_positions(rows)


@query
def shadow_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _shadow(spark, sf).select("request_id", "item_id", "rank", "learned_position")


@query
def shadow_overlap(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.shadow_report(_shadow(spark, sf), 5)
    return got.select("request_id", _r("overlap"), F.col("n_disagreements").alias("disagreements"))


@query
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.spearman(_shadow(spark, sf), "rank", "learned_position").select("request_id", _r("rank_correlation"))


# metrics


@query
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.coverage(_cards(spark, sf)).select("request_id", "n", _r("artist_coverage"), _r("album_coverage"), "n_types")


@query
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.diversity(_cards(spark, sf)).select("request_id", _r("diversity"))


@query
def novelty_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.novelty(_cards(spark, sf)).select("request_id", _r("mean_novelty"), _r("mean_unpopularity"))


@query
def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.source_mix(_cards(spark, sf)).select("request_id", "source_type", "n", _r("share"))


@query
def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.score_distribution(_cards(spark, sf)).select("request_id", _r("mean_score"), _r("var_score"), _r("min_score"), _r("max_score"))


@query
def duplicate_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.duplicate_rate(_cards(spark, sf)).select("request_id", _r("dup_artist_norm"), _r("dup_title_norm"), _r("dup_album_norm"))


@query
def shadow_report(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.shadow_report(_shadow(spark, sf), 5)
    said = F.transform("disagreements", lambda d: F.concat_ws(":", d["shown"], d["item_id"], d["learned"]))
    return got.select("request_id", "n_scored", _r("mean_learned"), _r("var_learned"), _r("min_learned"), _r("max_learned"), _r("overlap"), _r("rank_correlation"), "n_disagreements", _join(said).alias("disagreements"))


@query
def embedding_share(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.embedding_share(_both_channels(spark, sf)).select("request_id", _r("embedding_share"))


BUNDLE = ["artist_coverage", "album_coverage", "mean_novelty", "mean_unpopularity", "embedding_share", "dup_artist", "dup_title", "dup_album", "mean_score", "var_score", "min_score", "max_score", "diversity", "rank_correlation", "overlap"]


@query
def list_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bundle(tables.written(_shadow(spark, sf), "cards"), 5).select("request_id", "n_items", "n_types", "n_scored", "n_disagreements", *[_r(c) for c in BUNDLE])


@query
def macro_average(spark: SparkSession, sf: str) -> DataFrame:
    """Means over lists; those of learned scores over the lists that have some."""
    got = metrics.macro_average(metrics.bundle(tables.written(_shadow(spark, sf), "cards"), 5))
    return got.select("n_lists", "n_with_learned", *[_r(f"avg_{c}") for c in (*metrics.MEANS, *metrics.LEARNED_MEANS)])


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """A seed profile for each nation, from its first customer; those of the nations 5 and 11 are broken."""
    c = domain.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.min(F.struct("c_custkey", "c_mktsegment", "c_acctbal")).alias("c"))
    word = F.array(F.element_at(F.array(*map(F.lit, ("red", "blue", "green"))), (F.col("n") % 3 + 1).cast("int")))
    return c.select(
        F.concat(F.lit("nation-"), F.when(F.col("n") != 11, F.col("n")).otherwise(F.lit(None).cast("long")).cast("string")).alias("profile_id"), F.array(F.concat(F.lit("Brand#"), (F.col("n") + 1).cast("string"))).alias("liked_artists"), F.array(F.lit("STANDARD")).alias("genres"),
        F.array(F.lower("c.c_mktsegment")).alias("moods"), word.alias("tags"), F.when(F.col("n") == 5, "much").otherwise((F.col("n") / 24).cast("string")).alias("content_weight"), F.lit(None).cast("string").alias("novelty"), F.lit("0.3").alias("diversity"), (F.col("n") % 12 + 1).cast("string").alias("k"),
    )


@query
def seed_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Which seeds are requests, with which controls, and what is wrong with the others."""
    got = evaluate.checked(_seeds(spark, sf))
    return got.select("profile_id", "error", "k", _r("content_weight"), "novelty", "diversity", _join(F.col("tags")).alias("tags"))


@query
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each seed profile: its diagnostics, or why it has none."""
    report, _, _ = evaluate.evaluate(spark, sf, _seeds(spark, sf), tables.fresh_folder(spark, "evaluation"))
    return report.drop("latency_ms")


@query
def feedback_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The last accepted event of each request, as the streaming sink keeps it."""
    from tessera.streaming import feedback, sink

    folder = tables.fresh_folder(spark, "stream")
    _feedback(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(f"{folder}/in")
    events = feedback.read_events(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_batch=1)
    sink.start(events, f"{folder}/out", f"{folder}/checkpoint", late="3650 days").awaitTermination()
    return sink.latest(spark, f"{folder}/out").select("request_id", "event_id", "event_type")


@query
def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two commits of what searches have found; each version as it is read afterwards."""
    path = tables.fresh_folder(spark, "store")
    h = domain.hits(spark, sf)
    for kinds, day in (("'artist', 'genre'", "2024-01-01"), ("'tag', 'title'", "2024-01-02")):
        rows = h.where(f"source_type IN ({kinds})")
        versions.commit(store.observed(rows, rows.groupBy("item_id").agg(F.max("reliability").alias("quality")), F.lit(day).cast("timestamp_ntz")), path)
    read = [versions.read(spark, path, v).select(F.lit(v).alias("version"), "seen", F.size("source_types").alias("n_types"), "first_seen") for v in versions.versions(spark, path)]
    got = read[0].unionByName(read[1])
    return got.groupBy("version").agg(F.count("*").alias("n_items"), F.sum("seen").alias("seen"), F.sum("n_types").alias("n_types"), F.max("first_seen").alias("newest"))


@query
def daily_feedback(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.streaming.feedback import daily_counts

    return daily_counts(_feedback(spark, sf))
