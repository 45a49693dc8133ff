"""Views of the item table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import genre_array, matches_genre, primary_genre, release_year, same_genre


def item_genres(items: DataFrame, keep_blank: bool = False) -> DataFrame:
    """One row per item and genre, with the item's other columns."""
    return items.withColumn("genre", F.explode(genre_array(keep_blank=keep_blank)))


def item_features(items: DataFrame) -> DataFrame:
    """Title, genres (text and list), first genre and release year."""
    return items.select(
        "item_id",
        "title",
        "genres",
        genre_array().alias("genre_list"),
        primary_genre().alias("primary_genre"),
        release_year().alias("release_year"),
    )


def ratings_with_genres(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Each rating once per (non-blank) genre of its item.

    The join moves ratings with the compact genre list; the fan-out happens after it, on the same task.  No broadcast
    is forced: Spark broadcasts the items where their size allows and otherwise splits skewed items adaptively.
    """
    lists = items.select("item_id", genre_array().alias("genre_list"))
    joined = ratings.join(lists, "item_id")
    return joined.withColumn("genre", F.explode("genre_list")).drop("genre_list")


def genre_contains(rows: DataFrame, wanted: str) -> DataFrame:
    return rows.filter(matches_genre("genres", F.lit(wanted)))


def genre_equals(rows: DataFrame, wanted: str) -> DataFrame:
    return rows.filter(same_genre("genre", F.lit(wanted)))
