"""What each user likes, by genre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import ratio_or_zero
from tastegrid.operators.catalog import ratings_with_genres
from tastegrid.operators.skew import group_for_join

# Fixed value: a rated item adds its rating plus this much to the genre's weight.
PER_INTERACTION = 0.25


def _genre_totals(ratings: DataFrame, items: DataFrame, anchors: bool) -> DataFrame:
    """Per (user, genre): interactions, sum of ratings and, on request, the anchor item and its rating.

    The anchor is the user's best-rated, then latest, then lowest-numbered item of the genre.  Computing it in the same
    aggregate spares a second join and shuffle of the fanned-out ratings.
    """
    rows = ratings_with_genres(ratings, items)
    measures = [F.count(F.lit(1)).alias("genre_interactions"), F.sum("rating").alias("rating_sum")]
    if anchors:
        best = F.struct("rating", "ts", (-F.col("item_id").cast("long")).alias("item_down"))
        measures.append(F.max(best).alias("best"))
    totals = rows.groupBy("user_id", "genre").agg(*measures)
    if not anchors:
        return totals
    anchor = [(-F.col("best.item_down")).cast("int").alias("anchor_item_id"), F.col("best.rating").alias("anchor_rating")]
    return totals.select("user_id", "genre", "genre_interactions", "rating_sum", *anchor)


def _titled(totals: DataFrame, items: DataFrame) -> DataFrame:
    """Totals with their anchor's title: one row per user and genre meets the items, never a candidate or a recommendation."""
    titles = items.select(F.col("item_id").alias("anchor_item_id"), F.col("title").alias("anchor_title"))
    return totals.join(titles, "anchor_item_id", "left")


def user_taste(
    ratings: DataFrame, items: DataFrame, anchors: bool = True, titles: bool = False, users: DataFrame | None = None
) -> DataFrame:
    """One row per user with ``tastes``: the user's genres from best to least liked.

    Each element has genre, interactions, mean rating, weight (relative to the best genre) and the anchor, or on request
    the anchor's title instead.  The array has one element per distinct genre, so the genre vocabulary bounds it, however many ratings a
    user has.  With ``users`` the rows of these are ``asked``, and those of them without a rating have a row, too.
    """
    totals = _genre_totals(ratings, items, anchors)
    carried = ["rating_sum", "genre_interactions", "genre", *(["anchor_item_id", "anchor_rating"] if anchors else [])]
    if anchors and titles:
        totals, carried = _titled(totals, items), [*carried[:3], "anchor_title"]
    # Only what the rest follows from is shuffled.
    totals = totals.select("user_id", F.struct(*carried).alias("entry"))
    measures = [F.collect_list("entry").alias("entries")]
    if users is not None:
        asked = users.select("user_id").distinct().withColumn("asked", F.lit(True))
        totals = totals.unionByName(asked, allowMissingColumns=True)
        measures.append(F.coalesce(F.max("asked"), F.lit(False)).alias("asked"))
    per_user = group_for_join(totals, "user_id").agg(*measures)

    def keyed(entry):
        raw = entry["rating_sum"] + PER_INTERACTION * entry["genre_interactions"]
        average = entry["rating_sum"] / entry["genre_interactions"]
        order = [(-raw).alias("weight_down"), (-entry["genre_interactions"]).alias("interactions_down")]
        shown = [entry["genre"].alias("genre"), average.alias("genre_avg_rating"), raw.alias("raw_weight")]
        return F.struct(*order, *shown, *[entry[name].alias(name) for name in carried[3:]])

    ordered = per_user.withColumn("ordered", F.sort_array(F.transform("entries", keyed)))
    top = F.get(F.col("ordered"), F.lit(0))["raw_weight"]

    def element(entry):
        shown = [
            entry["genre"].alias("genre"),
            (-entry["interactions_down"]).alias("genre_interactions"),
            entry["genre_avg_rating"].alias("genre_avg_rating"),
            ratio_or_zero(entry["raw_weight"], top).alias("genre_weight"),
        ]
        return F.struct(*shown, *[entry[name].alias(name) for name in carried[3:]])

    marks = [] if users is None else ["asked"]
    return ordered.select("user_id", F.transform("ordered", element).alias("tastes"), *marks)


def user_genre_profile(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """One row per user and genre with its weight and its place among the user's genres."""
    placed = user_taste(ratings, items, anchors=False).select(
        "user_id", F.posexplode("tastes").alias("place", "taste")
    )
    return placed.select(
        "user_id",
        "taste.genre",
        "taste.genre_interactions",
        "taste.genre_avg_rating",
        "taste.genre_weight",
        (F.col("place") + 1).alias("favorite_rank"),
    )


def favorite_genre(taste: DataFrame) -> DataFrame:
    """Each user's best-liked genre."""
    first = F.col("tastes")[0]
    return taste.select(
        "user_id",
        first["genre"].alias("favorite_genre"),
        first["genre_weight"].alias("favorite_genre_weight"),
    )


def taste_lookup(taste: DataFrame) -> DataFrame:
    """The taste rows laid out for scoring: genre weights and anchors as maps, the favourite genre as columns.

    Built once per user, so that a candidate row only looks up.
    """
    first = F.get(F.col("tastes"), F.lit(0))
    columns = [
        F.map_from_arrays(F.col("tastes.genre"), F.col("tastes.genre_weight")).alias("genre_weights"),
        first["genre"].alias("favorite_genre"),
        first["genre_weight"].alias("favorite_genre_weight"),
    ]
    known = taste.schema["tastes"].dataType.elementType.names
    for field, name in (("anchor_item_id", "genre_anchors"), ("anchor_title", "genre_anchor_titles")):
        if field in known:
            columns.append(F.map_from_arrays(F.col("tastes.genre"), F.col(f"tastes.{field}")).alias(name))
    return taste.select("user_id", *columns, *[c for c in ("asked",) if c in taste.columns])


def anchor_items(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """The item that best stands for a user's taste in each genre."""
    anchors = _genre_totals(ratings, items, anchors=True).select("user_id", "genre", "anchor_item_id", "anchor_rating")
    titles = items.select(F.col("item_id").alias("anchor_item_id"), F.col("title").alias("anchor_title"))
    return anchors.join(titles, "anchor_item_id")
