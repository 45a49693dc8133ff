"""The sentences shown with a recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The wording.
BECAUSE = "Because you liked "
BECAUSE_DEFAULT = "similar movies"
SOCIAL_START = "Users similar to you liked this ("
SOCIAL_END = " ratings)"
GENRE = "Matches your favorite genre: "
GENRE_DEFAULT = "Mixed"
SEPARATOR = "; "


def with_anchor_title(recommendations: DataFrame, items: DataFrame) -> DataFrame:
    """Replace ``anchor_item_id`` by that item's title; looked up for the few final rows only."""
    titles = items.select(F.col("item_id").alias("anchor_item_id"), F.col("title").alias("anchor_title"))
    return recommendations.join(titles, "anchor_item_id", "left").drop("anchor_item_id")


def explain(recommendations: DataFrame) -> DataFrame:
    """Add the three reasons and their combined text."""
    because = F.concat(F.lit(BECAUSE), F.coalesce("anchor_title", F.lit(BECAUSE_DEFAULT)))
    raters = F.coalesce(F.col("rating_count"), F.lit(0)).cast("string")
    social = F.concat(F.lit(SOCIAL_START), raters, F.lit(SOCIAL_END))
    genre = F.concat(F.lit(GENRE), F.coalesce("primary_genre", "favorite_genre", F.lit(GENRE_DEFAULT)))
    reasons = recommendations.withColumns(
        {"explain_because": because, "explain_social": social, "explain_genre": genre}
    )
    return reasons.withColumn(
        "explain", F.concat_ws(SEPARATOR, "explain_because", "explain_social", "explain_genre")
    )
