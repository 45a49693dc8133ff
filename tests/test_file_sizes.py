"""Joins are planned by what rows take in memory, not by how small files pack them."""

from pyspark.sql import functions as F

from tastegrid.session import apply_session_settings
from tests.helpers import plan, tuples


def test_a_table_with_small_files_and_large_rows_is_not_broadcast(spark, tmp_path):
    apply_session_settings(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    text = F.repeat(F.lit("some words "), 20).alias("title")
    spark.range(20_000).select(F.col("id").alias("item_id"), text).coalesce(1).write.parquet(f"{tmp_path}/items")
    spark.range(60_000).select(F.pmod("id", F.lit(20_000)).alias("item_id"), "id").write.parquet(f"{tmp_path}/rows")
    size = sum(f.stat().st_size for f in (tmp_path / "items").glob("*.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * size))
    try:
        items, rows = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("items", "rows"))
        joined = rows.join(items, "item_id", "left")
        # The rows take 20,000 times 240 bytes, many times the limit.
        assert size < 400_000 and "Broadcast" not in plan(joined)
        assert joined.filter("title IS NULL").count() == 0 and joined.count() == 60_000
        few = items.filter("item_id < 3").select("item_id")
        assert tuples(rows.join(F.broadcast(few), "item_id").select("item_id").distinct()) == [(0,), (1,), (2,)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
