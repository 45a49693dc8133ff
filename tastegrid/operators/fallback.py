"""Top lists for users without usable history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.config import FallbackConfig
from tastegrid.functions import comparable, genre_array, popularity
from tastegrid.operators.popularity import item_stats
from tastegrid.operators.ranking import top_k
from tastegrid.schemas import FALLBACK


def _by_popularity():
    return [comparable("popularity_score").desc(), F.col("rating_count").desc(), F.col("item_id").asc()]


def genre_item_stats(ratings: DataFrame, items: DataFrame, min_count: int = 0) -> DataFrame:
    """Item stats per genre of the item, blank genres included; ``items`` holds one row per item.

    All ratings of an item belong to each of its genres, so ratings are aggregated per item once and only the item
    rows fan out.  A genre listed twice counts its item's ratings twice, as a join with the fanned-out list would.
    """
    listed = genre_array(keep_blank=True)
    per_item = items.join(item_stats(ratings).drop("popularity_score"), "item_id").withColumn("listed", listed)
    fanned = per_item.withColumn("genre", F.explode(F.array_distinct("listed")))
    others = F.size(F.array_remove("listed", F.col("genre")))
    return (
        fanned.withColumn("rating_count", F.col("rating_count") * (F.size("listed") - others))
        .filter(F.col("rating_count") >= min_count)
        .withColumn("popularity_score", popularity())
        .select("genre", "item_id", "title", "genres", "rating_count", "avg_rating", "popularity_score")
    )


def fallback_global(ratings: DataFrame, items: DataFrame, config: FallbackConfig = FallbackConfig()) -> DataFrame:
    """The overall top list; the only single-task step ranks its ``top_n`` rows."""
    stats = item_stats(ratings, config.min_rating_count)
    best = stats.join(items, "item_id").orderBy(*_by_popularity()).limit(config.top_n)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*_by_popularity())))
    return ranked.select(
        F.lit("global").alias("fallback_type"),
        F.lit(None).cast("string").alias("genre"),
        *FALLBACK.names[2:],
    )


def fallback_by_genre(ratings: DataFrame, items: DataFrame, config: FallbackConfig = FallbackConfig()) -> DataFrame:
    """The top list of every genre."""
    stats = genre_item_stats(ratings, items, config.min_rating_count)
    ranked = top_k(stats, ["genre"], _by_popularity(), config.top_n, spread_by=["item_id"])
    return ranked.select(F.lit("genre").alias("fallback_type"), *FALLBACK.names[1:])


def fallback_all(ratings: DataFrame, items: DataFrame, config: FallbackConfig = FallbackConfig()) -> DataFrame:
    return fallback_global(ratings, items, config).unionByName(fallback_by_genre(ratings, items, config))
