"""Stored rows of the users who ask are gathered where they were matched."""

from pyspark.sql import functions as F

from tastegrid.operators import serving
from tastegrid.session import apply_session_settings
from tests.helpers import plan, tuples


def test_matched_rows_are_listed_without_another_shuffle(spark, tmp_path):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fields = [F.lit("t").alias(c) for c in ("title", "genres", "explain")] + [F.lit(0.5).alias(c) for c in ("score", "als_score", "content_score")]
        rows = spark.range(60).select((F.col("id") % 20).cast("int").alias("user_id"), F.col("id").cast("int").alias("item_id"), F.col("id").cast("int").alias("rank"), *fields)
        rows.write.parquet(f"{tmp_path}/stored")
        stored = spark.read.parquet(f"{tmp_path}/stored")
        asked = spark.createDataFrame([(u,) for u in (1, 1, 3, 50, None)], "user_id int")
        lists = serving.stored_lists(serving.of_users(stored, asked, marked=True))
        plain = serving.stored_lists(serving.of_users(stored, asked))
        ids = F.col("stored.item_id").alias("ids")
        assert lists.columns == ["user_id", "stored"]
        assert tuples(lists.select("user_id", ids)) == tuples(plain.select("user_id", ids)) == [(1, [1, 21, 41]), (3, [3, 23, 43])]
        assert plan(lists).count("Exchange hashpartitioning") == plan(plain).count("Exchange hashpartitioning") - 1
        requests = asked.select(F.lit(1).cast("long").alias("request_id"), "user_id", F.lit(2).alias("top_n"), F.lit(None).cast("string").alias("genre"))
        served = serving.serve_hybrid(requests, stored)
        assert sorted(served.columns) == sorted([*requests.columns, "hybrid"])
        assert [len(r.hybrid) for r in served.orderBy("user_id").collect()] == [0, 2, 2, 2, 0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_tasks_take_less_than_sparks_default(spark):
    assert apply_session_settings(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
