"""How often and how well items are rated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import popularity, ratio_or_zero


def item_stats(ratings: DataFrame, min_count: int = 0, sums: bool = False) -> DataFrame:
    """Rating count, mean and popularity per item with at least ``min_count`` ratings; with ``sums`` the sum, too.

    Counts and sums are merged before the shuffle, so one item with most of the ratings is no hot spot.
    """
    stats = ratings.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("rating_count"),
        F.avg("rating").alias("avg_rating"),
        *([F.sum("rating").alias("rating_sum")] if sums else []),
    )
    kept = stats.filter(F.col("rating_count") >= min_count) if min_count > 0 else stats
    return kept.withColumn("popularity_score", popularity())


def item_popularity(ratings: DataFrame, sums: bool = False) -> DataFrame:
    """Item stats with popularity relative to the most popular item.

    The maximum is a scalar subquery over the same aggregate, whose shuffle Spark reuses; a window over everything
    would send all items to one task.
    """
    stats = item_stats(ratings, sums=sums)
    known = stats.withColumn("_highest", stats.agg(F.max("popularity_score")).scalar())
    share = ratio_or_zero(F.col("popularity_score"), F.col("_highest"))
    return known.withColumn("popularity_norm", share).drop("_highest")
