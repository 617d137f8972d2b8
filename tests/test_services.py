import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import cache, service

CLIENT = "tessera.sources.service:Fixture"
LISTS = {"Abba": [{"item_id": i, "title": f" t{i} ", "artist": "abba"} for i in (5, 6, "x", 7)], "none": []}
SETTINGS = json.dumps({"lists": LISTS, "default": [{"item_id": 9}], "broken": ["bad", 13], "signals": {"1": {"total": 3, "likedCount": 0, "liked_count": 4, "url": "u", "code": 200, "fee": 0, "level": "medium"}, "2": {"shareCount": 0, "fee": 1, "followCount": 8}}})


def source(spark, name, **options):
    service.register(spark)
    return spark.read.format(name).options(client=CLIENT, settings=SETTINGS, attempts="2", pause="0", **options).load()


def test_search_is_pushed_down_and_failures_are_rows(spark):
    df = source(spark, "tessera_search", keys_per_partition="1")
    rows = df.where(F.col("query").isin("ABBA", "bad", "none", "other") & (F.col("position") < 2))
    got = {(r.query, r.position, r.item_id, r.title, r.error, r.attempts) for r in rows.collect()}
    assert got == {("ABBA", 0, 5, "t5", None, 1), ("ABBA", 1, 6, "t6", None, 1), ("other", 0, 9, "", None, 1), ("bad", 0, None, None, "ConnectionError: no answer for bad", 2)}
    assert rows.rdd.getNumPartitions() == 4  # the failing partition is one of its own
    assert [r.item_id for r in df.where("query = 'abba'").orderBy("position").collect()] == [5, 6, 7]
    assert df.where("query = 'abba' AND query = 'other'").count() == 0
    assert df.where("query = 'abba' AND artist = 'x'").count() == 0  # filters that are not pushed still hold
    with pytest.raises(Exception, match="say what to ask for"):
        source(spark, "tessera_search").collect()


def test_signals(spark):
    raw = source(spark, "tessera_signals").where(F.col("item_id").isin(1, 2, 3, 13))
    assert {r.item_id: r.error is None for r in raw.collect()} == {1: True, 2: True, 3: True, 13: False}
    got = {r.item_id: tuple(r)[1:] for r in service.as_signals(raw).collect()}
    assert got == {1: (3, None, 4, None, True, 0.6), 2: (None, None, 0, 8, False, None), 3: (None, None, None, None, None, None)}


def test_searches_of_a_table(spark):
    asked = spark.createDataFrame([("abba", 2), ("abba", 1), ("bad", 3), ("none", 2), ("abba", 2)], "query string, limit int")
    got = service.search_all(asked, CLIENT, SETTINGS, attempts="2", pause="0")
    assert sorted((r.query, r.limit, r.position, r.item_id, r.error is None) for r in got.where("query <> 'bad'").collect()) == [("abba", 1, 0, 5, True), ("abba", 2, 0, 5, True), ("abba", 2, 1, 6, True)]
    assert [(r.query, r.limit, r.attempts) for r in got.where("error IS NOT NULL").collect()] == [("bad", 3, 2)]


def test_cache_asks_once(spark, tmp_path):
    """Hits, empty results and failures are entries: a second run looks nothing up."""
    asked = spark.createDataFrame([("abba", 2), ("none", 2), ("bad", 2)], "query string, limit int")
    seen = []

    def look_up(missing):
        seen.append(sorted(r.query for r in missing.collect()))
        return service.search_all(missing, CLIENT, SETTINGS, attempts="1")

    folder = f"{tmp_path}/cache"
    first = cache.search(asked, folder, look_up, "one")
    want = [("abba", 2, 0, 5), ("abba", 2, 1, 6)]
    assert sorted(map(tuple, first.collect())) == want
    more = asked.unionByName(spark.createDataFrame([("other", 1), ("abba", 1)], asked.schema))
    assert sorted(map(tuple, cache.search(asked, folder, look_up, "two").collect())) == want
    assert sorted(map(tuple, cache.search(more, folder, look_up, "three").collect())) == [("abba", 1, 0, 5), *want, ("other", 1, 0, 9)]
    assert seen == [["abba", "bad", "none"], [], ["abba", "other"]]
    got = {r.run: tuple(r)[1:] for r in cache.counters(spark, folder).collect()}
    assert got == {"one": (3, 0, 3, 1), "two": (3, 3, 0, 0), "three": (5, 3, 2, 0)}
    assert cache.entries(spark, folder).where("failed").count() == 1
