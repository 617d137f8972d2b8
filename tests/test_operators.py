import datetime as dt
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import config, queries
from tessera.functions import text as X
from tessera.functions import scoring as S
from tessera.operators import enrich, learning, metrics, rerank, retrieval, semantic, store, tables
from tessera.plans import domain, recommend
from tessera.sources import files
from tessera.streaming import feedback


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first().x


@pytest.mark.parametrize("title,want", [("Song (Live)", "song"), ("Song - Acoustic", "song"), ("8 (circle)", "circle"), ("爱 [demo] love", "love"), ("The Of", "")])
def test_norm_title(spark, title, want):
    assert one(spark, X.norm_title(F.col("t")), t=title) == want


def test_words_of_signals(spark):
    rows = spark.createDataFrame([(1, ["a"], "Dancing the queen", None)], "request_id long, text_words array<string>, lyric string, wiki string")
    assert recommend.signal_words(rows).first().text_words == ["a", "dancing", "queen"] and recommend.signal_words(rows.drop("lyric", "wiki")).columns == ["request_id", "text_words"]


def test_phrases(spark):
    assert one(spark, X.dedupe_phrases(F.array(F.lit(" Indie  pop "), F.lit("indie pop"))), t="") == ["Indie  pop"]
    assert one(spark, X.dedupe_phrases(F.array(*map(F.lit, ["Indie", "indie!", "r&b", "j-pop", "pop"])))  , t="") == ["Indie", "j-pop"]
    a, b = (F.array(*map(F.lit, w.split())) for w in ("my red hat", "red hat"))
    assert one(spark, X.contains_phrase(a, b), t="") and not one(spark, X.starts_with(a, b), t="")
    assert one(spark, X.jaccard(a, b), t="") == pytest.approx(2 / 3) and one(spark, X.jaccard(a, F.array().cast("array<string>")), t="") == 0


LABELS = [(["impression", "like"], 1.0, 1, "positive"), (["add_to_playlist"], 1.0, 1, "positive"), (["click"], 0.7, 1, "positive"), (["why_clicked"], 0.5, 1, "positive"), (["like", "dislike"], -1.0, 0, "negative"), (["click", "not_interested"], -1.0, 0, "negative"), (["click", "skip"], -1.0, 0, "negative"), (["impression"], 0.0, 0, "weak_negative")]


def test_weak_labels_and_training(spark):
    events = spark.createDataFrame([(i, i, e) for i, (es, *_) in enumerate(LABELS) for e in es], "request_id long, item_id long, event_type string")
    got = {r.request_id: (r.label, r.binary, r.kind) for r in learning.weak_labels(events).collect()}
    assert got == {i: tuple(x[1:]) for i, x in enumerate(LABELS)}
    rows = spark.createDataFrame([(float(i % 2), float(i % 3), i % 2, 1.0 if i % 2 else config.WEIGHTS.weak_negative_weight) for i in range(60)], "a double, b double, binary int, weight double")
    model, why = learning.train(rows, ["a", "b"])
    assert why == "trained" and learning.train_auc(model, rows, ["a", "b"]) > 0.99 and learning.importance(model, ["a", "b"])["a"] > 0
    assert learning.train(rows.limit(3), ["a", "b"])[0] is None and learning.train(rows.where("binary = 1"), ["a", "b"], min_samples=5)[1] == "one class only"


def test_mmr_caps_and_order(spark):
    rows = [(1, i, f"t{i}", "a" if i < 6 else f"b{i}", "", ["x"], 1 - i / 100) for i in range(10)] + [(2, 1, "t", "", "", [], 0.5)]
    df = spark.createDataFrame(rows, "request_id long, item_id long, title string, artist_norm string, album_norm string, taste_tokens array<string>, score double")
    got = rerank.mmr(df, 5, 0.0).orderBy("request_id", "rank").collect()
    assert [r.item_id for r in got if r.request_id == 1] == [0, 6, 7, 8, 9] and [r.promoted for r in got] == [False, True, True, True, True, False]
    assert rerank.mmr(df.where("artist_norm = 'a'"), 5, 0.5).count() == 1


def test_upsert(spark, tmp_path):
    schema = "item_id long, seen long, first_seen int, last_seen int, quality double, types array<string>"
    old, new = spark.createDataFrame([(1, 2, 10, 11, 0.5, ["a"]), (2, 1, 5, 5, 0.1, [])], schema), spark.createDataFrame([(1, 1, 20, 20, None, ["b", "a"]), (3, 1, 20, 20, 0.9, None)], schema)
    got = {r.item_id: tuple(r)[1:] for r in store.upsert(old, new).collect()}
    assert got == {1: (3, 10, 20, 0.5, ["a", "b"]), 2: (1, 5, 5, 0.1, []), 3: (1, 20, 20, 0.9, [])}


def test_enrich_rules(spark):
    grade = lambda level, rate: one(spark, enrich.audio_grade(F.lit(level).cast("string"), F.lit(rate).cast("int")), t="")
    assert [grade("lossless", 1), grade("exhigh", 1), grade("higher", 1), grade("medium", 1), grade("low", 1)] == [1.0, 1.0, 0.8, 0.6, 0.4]
    assert [grade(None, 999_000), grade("odd", 320_000), grade(None, 1), grade(None, 0), grade(None, None)] == [1.0, 0.85, 0.35, 0.35, None]
    assert one(spark, enrich.playable(F.lit("u"), F.lit(200), F.lit(0)), t="") and not one(spark, enrich.playable(F.lit("u"), F.lit(200), F.lit(1)), t="") and not one(spark, enrich.playable(F.lit(""), F.lit(None), F.lit(None)), t="")
    assert one(spark, enrich.first_truthy(F.lit(0), F.lit(None), F.lit(7), F.lit(3)), t="") == 7
    assert [enrich.budget(k) for k in (1, 5, 50)] == [6, 10, 16]


def test_metrics_edges(spark):
    cards = spark.createDataFrame([(1, 1, 1), (2, 1, 3), (2, 2, 2), (2, 3, 1)], "request_id long, rank int, learned_position int")
    got = {r.request_id: r.rank_correlation for r in metrics.spearman(cards, "rank", "learned_position").collect()}
    assert got[1] == 0 and got[2] == pytest.approx(-1)


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"item_id": "a", "title": "T", "tags": ["x"]}]}))
    assert files.read_catalogue(spark, str(tmp_path / "c.json")).first().tags == ["x"]
    (tmp_path / "bad.json").write_text('{"items": 3}')
    with pytest.raises(ValueError):
        files.read_catalogue(spark, str(tmp_path / "bad.json"))
    (tmp_path / "p.json").write_text(json.dumps({"profiles": [{"profile_id": "p", "k": 5}, {"label": "no id"}]}))
    (p,) = files.read_profiles(spark, str(tmp_path / "p.json")).collect()
    assert (p.profile_id, p.k, p.novelty) == ("p", 5, 0.3)


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i % 24), [" LIKE", "click", "nonsense"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = feedback.run_to_memory(feedback.daily_counts(feedback.read_events(spark, f"{tmp_path}/in", "ts timestamp, event_type string")), "counts", f"{tmp_path}/ck")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, feedback.daily_counts(df).collect())) != []


def test_mmr_and_content_weigh_text(spark):
    row = lambda i, score, codes: (1, i, f"t{i}", f"a{i}", "", [], codes, [1 / math.sqrt(len(codes))] * len(codes), score)
    df = spark.createDataFrame([row(1, 0.9, [0, 1]), row(2, 0.8, [0, 1]), row(3, 0.79, [2])], "request_id long, item_id long, title string, artist_norm string, album_norm string, taste_tokens array<string>, text_codes array<int>, text_weights array<double>, score double")
    assert [r.item_id for r in rerank.mmr(df, 3, 0.5).orderBy("rank").collect()] == [1, 3, 2]
    words = "dancing queen abba rock".split()
    pool = spark.createDataFrame([(9, 1, ["x"], ["x"], None), (1, 1, "dancing queen abba rock abba".split(), words, None), (1, 2, "waterloo abba rock abba rock rock".split(), None, None), (1, 3, ["gone"], None, "liked")], "request_id long, item_id long, text_words array<string>, profile_words array<string>, dropped string")
    idf = lambda df: math.log(4 / (1 + df)) + 1
    p, a, b = ({"d": n * idf(2), "q": n * idf(2), "w": m * idf(1), "abba": x * idf(3), "rock": y * idf(3)} for n, m, x, y in ((1, 0, 1, 1), (1, 0, 2, 1), (0, 1, 2, 3)))
    cos = lambda u, v: sum(u[k] * v[k] for k in u) / math.sqrt(sum(x * x for x in u.values()) * sum(x * x for x in v.values()))
    got = {(r.request_id, r.item_id): r.text_similarity for r in recommend.with_text(pool).collect()}
    assert got == {(9, 1): pytest.approx(1), (1, 1): pytest.approx(cos(p, a)), (1, 2): pytest.approx(cos(p, b))}


def brute_mmr(rows, k, diversity):
    """rows: (item, title, artist, album, taste, score); the plain greedy choice."""
    most_artist, most_album = rerank.caps(k)
    rows, chosen = sorted(rows, key=lambda r: (-r[5], r[1], r[0])), []

    def similarity(a, b):
        parts = [(0.35, float(a[2] == b[2] != ""))]
        if a[4] and b[4]:
            parts.append((0.25, len(set(a[4]) & set(b[4])) / len(set(a[4]) | set(b[4]))))
        if a[3] and b[3]:
            parts.append((0.20, float(a[3] == b[3])))
        return sum(w * x for w, x in parts) / sum(w for w, _ in parts)

    while len(chosen) < k:
        open_ = [r for r in rows if r not in chosen and (not r[2] or sum(c[2] == r[2] for c in chosen) < most_artist) and (not r[3] or sum(c[3] == r[3] for c in chosen) < most_album)]
        if not open_:
            break
        chosen.append(max(open_, key=lambda r: round((1 - diversity) * r[5] - diversity * max([similarity(r, c) for c in chosen], default=0), 12)))
    return [r[0] for r in chosen]


@pytest.mark.parametrize("k,diversity", [(5, 0.3), (10, 0.7), (12, 0.0)])
def test_mmr_against_brute_force(spark, k, diversity):
    r = random.Random(k)
    lists = {q: [(i, f"t{r.randint(0, 9)}", r.choice(["", "a", "b", "c", "d"]), r.choice(["", "x", "y"]), r.sample("pqrs", r.randint(0, 3)), r.randint(0, 20) / 20) for i in range(r.randint(1, 40))] for q in range(25)}
    rows = [(q, i, t, a, b, taste, s) for q, pool in lists.items() for i, t, a, b, taste, s in pool]
    df = spark.createDataFrame(rows, "request_id long, item_id long, title string, artist_norm string, album_norm string, taste_tokens array<string>, score double").repartition(3)
    got = {}
    for x in rerank.mmr(df, k, diversity).orderBy("request_id", "rank").collect():
        got.setdefault(x.request_id, []).append(x.item_id)
    assert got == {q: brute_mmr(pool, k, diversity) for q, pool in lists.items()}


def test_agreement_and_affinity(spark):
    got = lambda n, types, similar=None: one(spark, S.agreement(F.lit(n), F.array(*map(F.lit, types)), None if similar is None else F.lit(similar)), t="")
    assert got(1, ["artist_context"]) == pytest.approx(0.175) and got(2, ["artist", "genre"]) == pytest.approx(0.65)
    assert got(1, ["title"]) == pytest.approx(0.175 * 0.35) and got(1, ["tag"], 50) == pytest.approx(0.85 * 0.175 + 0.2) and got(1, ["tag"], 0) == pytest.approx(0.175)
    norms, weights = F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1.0), F.lit(0.75))
    assert one(spark, S.artist_affinity(F.lit(0.2), norms, weights, F.array(F.lit("b"), F.lit("c"))), t="") == 0.75
    assert one(spark, S.artist_affinity(F.lit(0.2), norms, weights, F.array().cast("array<string>")), t="") == 0.2


def test_items_with_several_artists(spark):
    """One liked artist among several makes a match; without one, the tokens of all are compared."""
    sf = "/root/testdata/sf0.001"
    rows = recommend.candidates(spark, sf)
    rows = rows.withColumn("item_artists", F.when(F.col("item_id") % 3 == 0, F.array(F.lit("nobody"), F.get("artists", 0))).when(F.col("item_id") % 3 == 1, F.array(F.lit("nobody"), F.lit("brand other"))).otherwise(F.array().cast("array<string>")))
    got = recommend.features(rows).select((F.col("item_id") % 3).alias("k"), "known_artist", "artist_match", "affinity", F.array_contains("artist_norms", F.col("artist_norm")).alias("own"))
    for x in got.groupBy("k").agg(F.min("artist_match").alias("low"), F.max("artist_match").alias("high"), F.max((F.col("known_artist") == 1) != F.col("own")).alias("differs")).collect():
        assert {0: (x.low, x.high) == (1, 1), 1: 0 < x.low and x.high < 1, 2: not x.differs}[x.k], x


def test_index_against_numpy(spark):
    """Fit, encode and recall: the projection of the truncated decomposition of the TF-IDF matrix, and the life of an index."""
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(3, 12))) for _ in range(60)]
    df = spark.createDataFrame([*enumerate(texts), (100, "  "), (101, None)], "id long, text string")
    built = semantic.fit(df, wanted=5)
    names = sorted({w for t in texts for w in t.split()})
    a = np.array([[t.split().count(w) for w in names] for t in texts], float)
    a *= np.log((1 + len(texts)) / (1 + (a > 0).sum(0))) + 1
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    v = a @ np.linalg.svd(a)[2][:5].T
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {x.item_id: np.array(x.v) for x in built.items.collect()}
    assert len(got) == 60 and np.allclose([[got[i] @ got[j] for j in range(60)] for i in range(60)], v @ v.T, atol=1e-4)
    found = built.recall(spark.createDataFrame([(7, texts[7]), (8, "unknown")], "id long, text string"), 3)
    rows = found.orderBy("rank").collect()
    assert rows[0].item_id == 7 and rows[0].score == pytest.approx(1) and {x.query_id for x in rows} == {7}
    assert semantic.as_hits(found, 0.68).columns == ["request_id", "plan_idx", "source_type", "query", "query_tokens", "reliability", "item_id", "position"]
    assert semantic.fit(df.limit(1)) is None and semantic.index(df.limit(10), None, None) is None
    df = df.where("id < 60")
    ids = df.select("id")
    assert semantic.index(df.withColumn("text", F.concat("text", F.lit(" more"))), ids, built) is built and semantic.index(df.where("id < 50"), ids, built) is not built


def test_store_reads_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", " x "), (2, "b", " "), (3, "c", None)], "item_id long, title string, text_for_embedding string")
    store.append(rows, f"{tmp_path}/s")
    kept = store.read_store(spark, f"{tmp_path}/s")
    assert kept.count() == 3 and [r.item_id for r in store.texts(kept).collect()] == [1] and store.lookup(kept, rows.where("item_id = 2")).count() == 1
    learning.write_schema(["a", "b"], {"n": 1}, f"{tmp_path}/schema")
    assert learning.read_schema(f"{tmp_path}/schema") == ["a", "b"]
    rows = spark.createDataFrame([(float(i % 2), i % 2, 1.0) for i in range(60)], "a double, binary int, weight double")
    model, _ = learning.train(rows, ["a"])
    learning.save(model, f"{tmp_path}/model")
    score = lambda m: [r.learned_score for r in learning.predict(m, rows, ["a"]).orderBy("a").collect()]
    assert score(learning.load(f"{tmp_path}/model")) == score(model)
    assert store.with_ids(rows).select("feedback_id").distinct().count() == 60
    excerpt, similar = enrich.deep(F.lit("a b  c"), F.array(F.lit(0), F.lit(4), F.lit(5)), 2, 1)
    assert one(spark, excerpt, t="") == "a b" and one(spark, similar, t="") == [4]


def above(df, operator):
    """The physical plan above the first such operator."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert operator in plan
    return plan[: plan.index(operator)]


def test_candidates_are_not_shuffled_by_item(spark):
    """What is known of an item comes with the hits: the only join above their merging is that of profiles, and results stay."""
    sf, profiles = "/root/testdata/sf0.001", domain.profiles(spark, "/root/testdata/sf0.001")
    rows = recommend.enriched(spark, sf)
    assert above(rows.select("request_id", "title", "comments", "taste_tokens", "tag_tokens"), "ObjectHashAggregate").count("Join") == 1
    apart = recommend.candidates(spark, sf, profiles, domain.hits(spark, sf, domain.plan(profiles)))
    same = ["request_id", "item_id", "n_hits", "sources", "types", "title", "t_title", "album_norm", "comments", "audio", "enriched", "tag_tokens"]
    got, want = rows.select(same), enrich.attach(apart, domain.signals(spark, sf)).select(same)
    assert set(rows.columns) == {*apart.columns, "enriched", *recommend.SIGNALS} and got.count() == want.count() and not got.exceptAll(want).limit(1).count()


def test_profiles_are_not_broadcast(spark):
    """Whatever size their files have."""
    profiles = tables.written(domain.profiles(spark, "/root/testdata/sf0.001"), "profiles")
    rows = profiles.select("request_id", F.explode("liked_ids").alias("item_id"), F.array("request_id").alias("phrase"))
    assert "BroadcastHashJoin" not in above(recommend.profile_once(rows, profiles), "FileScan")
    assert "BroadcastHashJoin" not in above(recommend.with_profile(rows, profiles.select("request_id", "artists")), "FileScan")


def test_planned_queries_are_not_broadcast(spark):
    """By the size of their profiles' files they would be; in memory they are many times that."""
    profiles = tables.written(domain.profiles(spark, "/root/testdata/sf0.001"), "profiles")
    plan = above(domain.hits(spark, "/root/testdata/sf0.001", domain.plan(profiles)), "FileScan")
    assert "SortMergeJoin [source_type" in plan and "BroadcastHashJoin" not in plan[: plan.index("SortMergeJoin [source_type")]
    assert "BroadcastHashJoin [request_id" not in queries._shadow(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_hits_of_a_search_travel_as_one_row(spark):
    """Hits are made after the shuffle on the request; merging them needs no other, and scores that know no signals read no line items but those bought."""
    rows = recommend.candidates(spark, "/root/testdata/sf0.001")
    plan = above(rows.select("request_id", "t_title", "taste_tokens"), "Generate posexplode")
    assert "Exchange" not in plan[plan.index("ObjectHashAggregate") :]
    dealt = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(request_id#\d+L?, 8\), REPARTITION_BY_NUM", dealt)  # twice the session's 4: not merged by size
    got, want = (x.select("request_id", "item_id", "position", "plan_idx") for x in (domain.hits(spark, "/root/testdata/sf0.001"), domain.plan(domain.profiles(spark, "/root/testdata/sf0.001")).join(domain.search_lists(spark, "/root/testdata/sf0.001"), ["source_type", "query"]).where("position < `limit`")))
    assert got.count() == want.count() and not got.exceptAll(want).limit(1).count()
    assert queries.QUERIES["tag_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("l_partkey") < queries.QUERIES["trust_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("l_partkey")


def test_bought_items_are_shuffled_once(spark):
    """On the item, where their texts are, and on the request; their numbering and the profiles reuse that."""
    plan = domain.liked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(request_id#", plan)) == 1 and not re.search(r"hashpartitioning\(request_id#\d+L?, item_id", plan)


def test_products_in_parts():
    """The scores of a cell never lie in memory whole, and are those of all pairs."""
    r = np.random.default_rng(3)
    tables_ = [pa.table({"v": pa.array(list(r.normal(size=(n, 5))))}) for n in (2 * semantic.AT_ONCE + 7, 11)]
    parts = list(semantic._products(*tables_))
    assert [(start, len(score)) for start, score in parts] == [(0, semantic.AT_ONCE), (semantic.AT_ONCE, semantic.AT_ONCE), (2 * semantic.AT_ONCE, 7)]
    a, b = (np.array(t.column("v").to_pylist()) for t in tables_)
    assert np.allclose(np.concatenate([score for _, score in parts]), a @ b.T)


def test_counts_of_rows_that_stand_for_several(spark):
    hits = spark.createDataFrame([("artist", 1, 3), ("artist", 1, 2), ("tag", 2, 1), ("tag", 3, 4)], "source_type string, item_id long, n long")
    whole = hits.select("source_type", "item_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col")
    assert sorted(retrieval.route_counts(hits, "n").collect()) == sorted(retrieval.route_counts(whole).collect()) == [("artist", 5, 1), ("tag", 5, 2)]


def test_cached_search_plans_once(spark):
    """Both runs over the cache read one table of planned queries."""
    planned, real = [], tables.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tables, "written", lambda df, tag: planned.append(tag) or real(df, tag))
        queries._cached(spark, "/root/testdata/sf0.001")
    assert planned == ["planned"]
