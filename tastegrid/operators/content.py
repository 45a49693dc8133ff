"""Candidates scored against the user's taste."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.functions import genre_array, primary_genre
from tastegrid.operators.catalog import item_features
from tastegrid.operators.taste import taste_lookup

CANDIDATE = ("user_id", "item_id", "als_score")

# So many genres of an item are looked up one by one, in compiled code; what lists have beyond that goes on with array
# functions, which Spark interprets for every row and for which it copies the user's weights to every row.
LOOKED_UP = 6
# Where the longest list is known, up to so many, and none is left for array functions.
LOOKED_UP_AT_MOST = 16


def seen_pairs(ratings: DataFrame) -> DataFrame:
    return ratings.select("user_id", "item_id").distinct()


def drop_seen(candidates: DataFrame, ratings: DataFrame, by_item: bool = False) -> DataFrame:
    """Candidates the user has not rated yet.

    ``by_item`` places the seen pairs by their item; under ``session.placed_by_part`` the candidates follow them, and need
    no further shuffle to meet anything of the item.  An item has at most one pair for each user.

    The pairs are made distinct first: that costs no extra shuffle and keeps a pair rated over and over from becoming
    a hot key of the join. Distinct pairs spread evenly, so that a task's share of them is hashed instead of sorting
    both sides.
    """
    rated = ratings.select("user_id", "item_id").repartition("item_id") if by_item else ratings
    return candidates.join(seen_pairs(rated).hint("shuffle_hash"), ["user_id", "item_id"], "left_anti")


def merge_copies(candidates: DataFrame) -> DataFrame:
    """Equal candidate rows as one row with their number; right after ``drop_seen`` this needs no further shuffle."""
    return candidates.groupBy(*CANDIDATE).agg(F.count(F.lit(1)).cast("int").alias("copies"))


def _found_weights(rows: DataFrame, longest: int | None) -> tuple[DataFrame, Column, Column, Column]:
    """The weights of each row's genres (null where the user has none): their sum, largest one and number.

    ``longest`` says how many genres a list has at most, if that is known.
    """
    known = longest is not None and longest <= LOOKED_UP_AT_MOST
    names = [f"_weight_{place}" for place in range(longest if known else LOOKED_UP)]
    # Beyond the end of the list the place is null, and so is its weight.
    looked_up = {name: F.col("genre_weights")[F.get("genre_list", F.lit(place))] for place, name in enumerate(names)}
    total, largest, matches = F.lit(0.0), F.lit(None).cast("double"), F.lit(0)
    for name in names:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
        largest = F.greatest(largest, F.col(name))
        matches = matches + F.col(name).isNotNull().cast("int")
    if known:
        return rows.withColumns(looked_up), total, largest, matches
    others = F.slice("genre_list", LOOKED_UP + 1, F.size("genre_list"))
    weights = F.transform(others, lambda genre: F.col("genre_weights")[genre])
    rest = F.col("_weight_rest")
    found = rows.withColumns({**looked_up, "_weight_rest": F.when(F.size("genre_list") > LOOKED_UP, weights)})
    longer = F.aggregate(rest, total, lambda sum_, weight: sum_ + F.coalesce(weight, F.lit(0.0)))
    return (
        found,
        F.when(rest.isNull(), total).otherwise(longer),
        F.greatest(largest, F.array_max(rest)),
        matches + F.coalesce(F.size(F.array_compact(rest)), F.lit(0)),
    )


def score_content(candidates: DataFrame, features: DataFrame, taste: DataFrame, longest: int | None = None) -> DataFrame:
    """Add the overlap of each candidate's genres with the user's weights, and what the taste row says about them.

    ``features`` comes from ``item_features`` (further columns pass through) and ``taste`` from ``user_taste``.  Both
    sides hold one row per key, so candidates never fan out: two joins, and the arithmetic runs within the row.
    Unmatched genres count as 0 in the mean; an unknown item or user scores 0.  Equal candidate rows merge into one
    whose matches add up.  ``longest`` is the length of the longest ``genre_list``, for those who know it.
    """
    merged = candidates if "copies" in candidates.columns else merge_copies(candidates)
    return score_beside(merged.join(features, "item_id", "left"), taste, longest)


def score_beside(merged: DataFrame, taste: DataFrame, longest: int | None = None) -> DataFrame:
    """``score_content`` of merged candidates that have their item's features beside them.

    Features may hold the text ``genres`` instead of list and first genre: it is half as long when it is shuffled to the
    user's weights, and split after that.  Of a taste made for some users (``asked``), only their candidates stay.
    """
    lookup = taste_lookup(taste)
    rows = merged.join(lookup, "user_id", "left")
    if "asked" in lookup.columns:
        rows = rows.filter("asked").drop("asked")
    if "genre_list" not in rows.columns:
        rows = rows.withColumns({"genre_list": genre_array(), "primary_genre": primary_genre()})
    found, total, largest, matches = _found_weights(rows, longest)
    length = F.size("genre_list")
    scores = {
        "content_score": F.coalesce(F.when(length > 0, total / F.nullif(length, F.lit(0))), F.lit(0.0)),
        "max_genre_weight": F.coalesce(largest, F.lit(0.0)),
        "genre_match_count": matches * F.col("copies"),
    }
    if "genre_anchors" in lookup.columns:
        scores["anchor_item_id"] = F.col("genre_anchors")[F.col("primary_genre")]
    if "genre_anchor_titles" in lookup.columns:
        scores["anchor_title"] = F.col("genre_anchor_titles")[F.col("primary_genre")]
    used = ("genre_weights", "genre_anchors", "genre_anchor_titles", "copies", "genre_list")
    kept = [name for name in rows.columns if name not in used]
    return found.withColumns(scores).select(*kept, *scores)


def content_score(candidates: DataFrame, items: DataFrame, taste: DataFrame) -> DataFrame:
    """Only the content columns of each candidate."""
    scored = score_content(candidates, item_features(items).select("item_id", "genre_list", "primary_genre"), taste)
    return scored.select(*CANDIDATE, "content_score", "max_genre_weight", "genre_match_count")
