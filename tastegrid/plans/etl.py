"""Raw text to silver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastegrid.config import USER_BUCKETS
from tastegrid.operators.cleaning import cleaned_items, cleaned_ratings, group_counts, item_groups, rating_groups
from tastegrid.session import release, reuse
from tastegrid.sources.raw import read_items, read_ratings
from tastegrid.sources.tables import write_silver_items, write_silver_ratings


def run_etl(
    spark: SparkSession,
    raw_ratings: str,
    raw_items: str,
    silver_ratings: str,
    silver_items: str,
    buckets: int = USER_BUCKETS,
) -> DataFrame:
    """Clean both raw tables, write the silver tables and return the row counts.

    Each raw file is read and parsed once: its groups of equal keys are kept, and the silver table and the counts both
    come from them.
    """
    ratings, items = reuse(rating_groups(read_ratings(spark, raw_ratings))), reuse(item_groups(read_items(spark, raw_items)))
    write_silver_ratings(cleaned_ratings(ratings), silver_ratings, buckets)
    write_silver_items(cleaned_items(items), silver_items)
    counts = group_counts(ratings, "ratings").unionByName(group_counts(items, "items"))
    # One row per table.
    stats = spark.createDataFrame(counts.collect(), counts.schema)
    for kept in (ratings, items):
        release(kept)
    return stats
