"""Work on whole requests is dealt by how many there are, so that a task sorts no more on a larger input."""

from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import text as X
from tessera.plans import domain
from tessera.plans import recommend as R

SF = "/root/testdata/sf0.001"


def parts(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_partitions_follow_the_number_of_requests(spark):
    rows = spark.range(40_000).select(F.col("id").alias("request_id"))
    few, many = domain.by_request(rows, 100), domain.by_request(rows, 40_000)
    assert parts(few) == 8
    assert parts(many) == 40_000 / domain.REQUESTS_AT_ONCE


def test_candidates_and_pools_are_dealt_so_and_stay_the_same(spark, monkeypatch):
    profiles = domain.profiles(spark, SF).where("request_id % 5 = 1").cache()
    assert domain.n_requests(spark, SF, profiles) == profiles.count()
    pool = lambda: R.ranked_pool(spark, SF, profiles, R.candidates(spark, SF, profiles)).select("request_id", "item_id", F.round("score", 8))
    once = pool().cache()
    assert once.count() and parts(R.candidates(spark, SF, profiles)) <= 8
    monkeypatch.setattr(domain, "REQUESTS_AT_ONCE", 1)
    assert parts(R.candidates(spark, SF, profiles)) > 8
    again = pool()
    assert again.exceptAll(once).count() == 0 and once.exceptAll(again).count() == 0
    assert "REPARTITION_BY_NUM" in again._jdf.queryExecution().executedPlan().toString()


def test_cards_make_profiles_once(spark):
    read = queries.QUERIES["pick_types"](spark, SF).inputFiles()
    assert not any("orders.parquet" in f for f in read)


def test_hits_are_shuffled_as_rows_of_searches(spark):
    """merge_tracks, merge_channels: hits are made after the shuffle by request, so they are never shuffled one by one."""
    for name in ("merge_tracks", "merge_channels"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("Initial Plan")[0].splitlines()
        made = next(i for i, line in enumerate(lines) if "Generate posexplode" in line)
        assert not any("Exchange" in line for line in lines[:made]), name


def test_scores_carry_only_what_is_asked_for(spark):
    """What nobody asks for goes neither through Python nor into the merging of hits, which is one sort."""
    plan = queries.QUERIES["final_score"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    step = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert not any(c in step for c in ("sources", "taste_tokens", "text_codes"))
    last = plan.split("Exchange")[0]
    assert "Window" in last and "ObjectHashAggregate" not in last


def test_tokens_without_others_keep_order_and_repeats(spark):
    rows = spark.createDataFrame([(["b", "a", "c"], ["a"]), (["b", "a", "b", "c"], ["c"]), ([], ["a"]), (["a"], [])], "t array<string>, gone array<string>")
    assert [x.rest for x in rows.select(X.without(F.col("t"), F.col("gone")).alias("rest")).collect()] == [["b", "c"], ["b", "a", "b"], [], ["a"]]
