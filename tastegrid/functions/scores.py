"""Score arithmetic."""

from __future__ import annotations

from itertools import accumulate
from math import log2

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastegrid.config import MAX_RATING, MIN_RATING, ORDER_SCALE


def als_norm(score: str = "als_score") -> Column:
    """Position of a predicted rating on the rating scale, clamped to [0, 1]."""
    position = (F.col(score) - MIN_RATING) / (MAX_RATING - MIN_RATING)
    return F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0))


def popularity(mean: str = "avg_rating", count: str = "rating_count") -> Column:
    return F.col(mean) * F.log1p(F.col(count))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """``part / whole`` where ``whole`` is positive, else 0."""
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0.0))).otherwise(F.lit(0.0))


def comparable(score: str) -> Column:
    """The score as it enters an ordering: a whole number of the smallest difference that counts."""
    return F.floor(F.col(score) * F.lit(ORDER_SCALE) + F.lit(0.5))


def discount(position: Column) -> Column:
    """Gain of a hit at a 0-based position."""
    return F.lit(1.0) / F.log2(position + F.lit(2.0))


def ideal_dcg(relevant: Column, k: int) -> Column:
    """DCG of a list whose first ``min(relevant, k)`` places are all hits; 0 without relevant items.

    The partial sums depend on ``k`` alone, so they enter the plan as one literal array.
    """
    sums = F.array(*[F.lit(total) for total in accumulate(1.0 / log2(place + 2) for place in range(k))])
    reached = F.least(F.coalesce(relevant, F.lit(0)), F.lit(k)).cast("int")
    return F.coalesce(F.get(sums, reached - 1), F.lit(0.0))
