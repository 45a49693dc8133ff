"""Blend, boost, diversify and cut scored candidates."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.config import BlendConfig
from tastegrid.functions import als_norm, comparable, ratio_or_zero
from tastegrid.operators.numbering import numbered
from tastegrid.operators.ranking import top_k

# Below this penalty a better row of the same genre no longer safely outranks a worse one.
_SMALLEST_PENALTY = 1e-3


def hybrid_score(scored: DataFrame, config: BlendConfig = BlendConfig()) -> DataFrame:
    """Add ``als_norm`` and the blend of collaborative and content score."""
    blended = config.als_weight * F.col("als_norm") + config.content_weight * F.col("content_score")
    return scored.withColumn("als_norm", als_norm()).withColumn("hybrid_score", blended)


def year_extent(rows: DataFrame) -> DataFrame:
    """Oldest and newest release year, as one row."""
    return rows.agg(F.struct(F.min("release_year").alias("oldest"), F.max("release_year").alias("newest")))


def recency_norm(rows: DataFrame, extent: DataFrame) -> DataFrame:
    """Place of the release year between the oldest and the newest year of ``extent`` (0 where it has no width).

    The extent is a scalar subquery: two numbers reach the rows, no window over everything and no join.
    """
    years = F.col("_years")
    span = years["newest"] - years["oldest"]
    placed = ratio_or_zero(F.col("release_year") - years["oldest"], span)
    # One column holds the subquery; naming it in each expression would plan it anew every time.
    known = rows.withColumn("_years", extent.scalar())
    return known.withColumn("recency_norm", F.coalesce(F.when(span > 0, placed), F.lit(0.0))).drop("_years")


def deepest_useful_rank(top_n: int, config: BlendConfig) -> int | None:
    """The genre rank below which no row can reach a user's ``top_n``; None if there is no such rank.

    The three boosted signals lie in [0, 1] (``rerank`` fails on any other value), so two rows of a genre differ by at most ``spread`` in boosts.  A row
    placed more than ``spread / penalty`` behind another one of its genre therefore ends up below it; once ``top_n``
    rows are ahead like that, it is out.  One place is added for scores that are equal within rounding.
    """
    if config.diversity_penalty < _SMALLEST_PENALTY:
        return None
    spread = abs(config.genre_boost) + abs(config.popularity_boost) + abs(config.recency_boost)
    return top_n + floor(spread / config.diversity_penalty) + 1


def within_unit(name: str) -> Column:
    """The column, or an error where it lies outside [0, 1] by more than rounding: the cut of ``rerank`` rests on that."""
    value = F.col(name)
    wrong = F.raise_error(F.concat(F.lit(f"{name} is outside [0, 1]: "), value.cast("string"))).cast("double")
    return F.when(value.between(-1e-9, 1 + 1e-9) | value.isNull(), value).otherwise(wrong)


def placed_in_genre(keyed: DataFrame, genre_key: list[str]) -> DataFrame:
    """``genre_rank`` of all rows without a bound on it: places from sorted ranges, so that no task holds a group."""
    falling = keyed
    along = []
    for name in ("_quality", "_liked"):
        # Falling, null last, as an ascending order.
        falling = falling.withColumns({f"{name}_none": F.col(name).isNull(), f"{name}_down": -F.col(name)})
        along += [f"{name}_none", f"{name}_down"]
    placed = numbered(falling, genre_key, [*along, "item_id"], "genre_rank")
    return placed.withColumn("genre_rank", (F.col("genre_rank") + 1).cast("int")).drop(*along)


def rerank(rows: DataFrame, extent: DataFrame, top_n: int, config: BlendConfig = BlendConfig()) -> DataFrame:
    """The ``top_n`` rows of each user by boosted, diversity-penalised hybrid score.

    Rows carry content columns, ``popularity_norm`` (null for unrated items), ``primary_genre`` and ``release_year``.
    Candidates are cut per (user, first genre) before they are ranked per user, so neither ranking ever holds more
    than a bounded number of rows of one user. Without a diversity penalty nothing can be cut: then genre ranks come
    from sorted ranges, which are kept (``operators.numbering``).
    """
    known = rows.fillna(0.0, ["popularity_norm"])
    known = known.withColumns({name: within_unit(name) for name in ("popularity_norm", "max_genre_weight")})
    filled = hybrid_score(known, config)
    # The ordering keys are columns of their own, computed once for all rankings.
    keyed = filled.withColumns({"_quality": comparable("hybrid_score"), "_liked": comparable("popularity_norm")})
    quality = [F.col("_quality").desc(), F.col("_liked").desc(), F.col("item_id").asc()]
    genre_key = ["user_id", "primary_genre"]
    depth = deepest_useful_rank(top_n, config)
    if depth is None:
        placed = placed_in_genre(keyed, genre_key)
    else:
        # The rows come from a join on the user and lie together by it.
        placed = top_k(keyed, genre_key, quality, depth, "genre_rank", ["item_id", "als_score"], colocated=True)
    score = (
        F.col("hybrid_score")
        + config.genre_boost * F.col("max_genre_weight")
        + config.popularity_boost * F.col("popularity_norm")
        + config.recency_boost * F.col("recency_norm")
        - config.diversity_penalty * (F.col("genre_rank") - 1)
    )
    final = [comparable("rerank_score").desc(), *quality]
    scored = recency_norm(placed, extent).withColumn("rerank_score", score)
    return top_k(scored, ["user_id"], final, top_n).drop("_quality", "_liked")
