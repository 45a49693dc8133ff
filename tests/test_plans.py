"""What the physical plans look like, and that a hot key does not land in one task."""

import re

import pytest
from pyspark.sql import functions as F

from tastegrid.operators import catalog, content, fallback, popularity, profiles, taste
from tastegrid.operators.serving import user_has_history
from tastegrid.plans import hybrid
from tests.helpers import plan, tuples
from workload.views import Views


@pytest.fixture
def conf(spark):
    """Set options for one test."""
    old = {}

    def put(**options):
        for name, value in options.items():
            key = name.replace("__", ".")
            old.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def no_broadcast(conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1")


@pytest.fixture
def stored(spark, small_dir, tmp_path):
    """Ratings, items and candidates as parquet tables."""
    view, found = Views(spark, small_dir), []
    for name in ("ratings", "items", "candidates"):
        getattr(view, name)().write.parquet(f"{tmp_path}/{name}")
        found.append(spark.read.parquet(f"{tmp_path}/{name}"))
    return found


def test_scans_read_only_what_they_need(stored):
    ratings, items, _ = stored
    text = plan(popularity.item_popularity(ratings))
    assert "ReadSchema: struct<item_id:int,rating:double>" in text and "user_id" not in text.split("ReadSchema")[1]
    assert "ReadSchema: struct<user_id:int,item_id:int>" in plan(content.seen_pairs(ratings))
    assert "PushedFilters: [IsNotNull(rating), GreaterThanOrEqual(rating,4.0)]" in plan(
        ratings.filter(F.col("rating") >= 4.0).select("user_id")
    )


def test_no_window_over_everything(stored):
    ratings, items, candidates = stored
    text = plan(hybrid.rerank_candidates(candidates, ratings, items))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    for line in text.splitlines():
        if " Window [" in line:
            assert "[user_id" in line
    # Only the one-row extents are gathered in one partition.
    for before, after in zip(text.splitlines(), text.splitlines()[1:]):
        if "Exchange SinglePartition" in before:
            assert "partial_" in after


def test_rankings_are_cut_before_the_shuffle(stored):
    ratings, items, candidates = stored
    assert "WindowGroupLimit [genre" in plan(fallback.fallback_by_genre(ratings, items))
    assert plan(hybrid.rerank_candidates(candidates, ratings, items)).count("WindowGroupLimit") >= 3
    history = ratings.select(F.col("user_id").alias("profile_id"), F.col("ts").alias("history_id"))
    assert "Partial" in plan(profiles.history_last_n(history))
    assert "TakeOrderedAndProject" in plan(fallback.fallback_global(ratings, items))


def test_aggregates_merge_before_the_shuffle(stored):
    ratings, items, _ = stored
    assert "partial_count" in plan(popularity.item_stats(ratings))
    assert "partial_sum(rating" in plan(taste.user_genre_profile(ratings, items))


def test_popularity_scans_once(stored):
    text = plan(popularity.item_popularity(stored[0]), run=True)
    final = text.split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 1 and "Subquery" in final


def test_ratings_meet_items_before_they_fan_out(stored, conf):
    no_broadcast(conf)
    text = plan(catalog.ratings_with_genres(*stored[:2]))
    assert text.index("Generate explode") < text.index("SortMergeJoin")


def hot(spark, users=50, items=400):
    """Candidates of which one user holds more than a third."""
    many = spark.range(users * 100).select(
        F.pmod("id", F.lit(users)).cast("int").alias("user_id"),
        F.pmod(F.col("id") * 31, F.lit(items)).cast("int").alias("item_id"),
    )
    one = spark.range(6000).select(F.lit(7).alias("user_id"), F.col("id").cast("int").alias("item_id"))
    score = (F.pmod(F.col("user_id") * 13 + F.col("item_id") * 7, F.lit(40)) / 8).cast("double")
    return many.unionByName(one).distinct().withColumn("als_score", score)


SPLIT = dict(
    spark__sql__shuffle__partitions="16",
    spark__sql__adaptive__coalescePartitions__enabled="false",
    spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
    spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
    spark__sql__files__maxPartitionBytes="4KB",
    spark__sql__files__openCostInBytes="1",
)


def test_hot_user_is_split_and_results_stay(spark, small_dir, conf, tmp_path):
    view = Views(spark, small_dir)
    columns = ("user_id", "item_id", "genre_rank", "rank")
    hot(spark).repartition(8).write.parquet(f"{tmp_path}/hot")
    candidates = spark.read.parquet(f"{tmp_path}/hot")
    plain = tuples(hybrid.rerank_candidates(candidates, view.ratings(), view.items(), top_n=5), *columns)
    no_broadcast(conf)
    conf(**SPLIT)
    best = hybrid.rerank_candidates(spark.read.parquet(f"{tmp_path}/hot"), view.ratings(), view.items(), top_n=5)
    assert tuples(best, *columns) == plain
    text = plan(best, run=True)
    assert "SortMergeJoin(skew=true) [user_id" in text
    # The split user goes on in slices, not in one task.
    assert re.search(r"hashpartitioning\(user_id#\d+, primary_genre#\d+, _shard#", text)


def test_hot_item_in_ratings_is_split(spark, small_dir, conf, tmp_path):
    rating = (F.pmod(F.col("id") * 7, F.lit(10)) / 2 + 0.5).cast("double").alias("rating")
    item = F.when(F.col("id") < 6000, 3).otherwise(F.pmod("id", F.lit(200))).cast("int").alias("item_id")
    user = F.pmod("id", F.lit(997)).cast("int").alias("user_id")
    spark.range(15000).select(user, item, rating, F.col("id").alias("ts")).repartition(8).write.parquet(f"{tmp_path}/hot")
    items = Views(spark, small_dir).items()
    plain = tuples(taste.user_genre_profile(spark.read.parquet(f"{tmp_path}/hot"), items))
    no_broadcast(conf)
    conf(**SPLIT)
    profile = taste.user_genre_profile(spark.read.parquet(f"{tmp_path}/hot"), items)
    assert tuples(profile) == plain
    assert "SortMergeJoin(skew=true) [item_id" in plan(profile, run=True)


def test_hot_user_in_requests_is_split(spark, small_dir, conf, tmp_path):
    view = Views(spark, small_dir)
    user = F.when(F.col("id") < 8000, 7).otherwise(F.pmod("id", F.lit(200))).cast("int").alias("user_id")
    asked = spark.range(20000).select(F.col("id").alias("request_id"), user)
    asked.repartition(8).write.parquet(f"{tmp_path}/hot")
    no_broadcast(conf)
    conf(**SPLIT)
    known = user_has_history(spark.read.parquet(f"{tmp_path}/hot"), view.ratings())
    assert known.filter("has_history").count() == asked.join(view.ratings().select("user_id").distinct(), "user_id").count()
    assert "SortMergeJoin(skew=true) [user_id" in plan(known, run=True)
