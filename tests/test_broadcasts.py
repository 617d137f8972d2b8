"""What grows with the input is never broadcast, however small its files look, and recall's hits travel as those of searches do."""

from pyspark.sql import functions as F

from tessera.plans import domain
from tessera.plans import recommend as R

SF = "/root/testdata/sf0.001"
HITS = "request_id long, plan_idx int, source_type string, query string, query_tokens array<string>, reliability double, item_id long, position int"


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_liked_items_and_profiles_are_not_broadcast(spark):
    assert broadcasts(domain.liked(spark, SF)) == 0
    assert broadcasts(domain.profiles(spark, SF)) == 0


def test_lists_and_items_are_not_broadcast(spark):
    asked = domain.search_lists(spark, SF).select(F.lit(1).alias("request_id"), F.lit(0).alias("plan_idx"), "source_type", "query", F.lit(1.0).alias("reliability"), F.lit(12).alias("limit"))
    assert broadcasts(domain.found(spark, SF, asked, domain.items(spark, SF))) == 0
    hits = spark.createDataFrame([(1, 0, "artist", "x", ["x"], 0.5, 7, 0)], HITS)
    assert broadcasts(R.candidates(spark, SF, domain.profiles(spark, SF), hits)) == 0


def test_recall_with_lists_gives_the_same_candidates(spark):
    profiles = domain.profiles(spark, SF).where("request_id % 10 = 1").cache()
    items = [r.item_id for r in domain.catalogue(spark, SF).orderBy("item_id").limit(4).collect()]
    more = profiles.select("request_id", F.lit(0).alias("plan_idx"), F.lit("embedding").alias("source_type"), F.posexplode(F.array(*map(F.lit, items))).alias("position", "item_id"))
    more = more.select("request_id", "plan_idx", "source_type", F.col("item_id").cast("string").alias("query"), F.array().cast("array<string>").alias("query_tokens"), F.lit(0.6).alias("reliability"), "item_id", "position")
    hits = R.with_recall(domain.hits(spark, SF, domain.plan(profiles)), more)
    columns = ["request_id", "item_id", "n_hits", "n_names", "sources", "types", "first_hit", "best_value", "mean_position", "max_rank", F.sort_array("query_tokens").alias("q"), F.sort_array("taste_tokens").alias("t"), "title", "t_title", "album_norm"]
    a, b = (R.candidates(spark, SF, profiles, **given).select(columns) for given in ({"hits": hits}, {"more": more}))
    assert a.where(F.array_contains("types", "embedding")).count() == 4 * profiles.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_plans_of_different_texts_share_the_shuffle_of_liked_items(spark):
    own = domain.liked(spark, SF)
    both = own.select("request_id", "pos", F.col("title").alias("text")).unionByName(own.select("request_id", "pos", F.col("artist").alias("text")))
    assert len(both.collect()) == 2 * own.count()
    assert any("ReusedExchange" in line and "texts" in line for line in both._jdf.queryExecution().executedPlan().toString().splitlines())
