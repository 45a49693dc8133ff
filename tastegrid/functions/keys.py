"""Keys, buckets and the rating-scale predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastegrid.config import MAX_RATING, MIN_RATING, USER_BUCKETS

# Fixed values of the split hash: two rounds of a multiplicative congruential step modulo the Mersenne prime 2^31 - 1.
_MODULUS = 2147483647
_USER_STEP = 48271
_ITEM_STEP = 69621
SPLIT_BUCKETS = 10000


def user_bucket(user: str = "user_id", buckets: int = USER_BUCKETS) -> Column:
    return F.pmod(F.col(user), F.lit(int(buckets))).cast("int")


def on_scale(rating: str = "rating") -> Column:
    """True for ratings within the scale, false for all others including null and NaN."""
    return F.coalesce(F.col(rating).between(F.lit(MIN_RATING), F.lit(MAX_RATING)), F.lit(False))


def split_bucket(user: str, item: str, seed: int) -> Column:
    """A number in ``0 .. SPLIT_BUCKETS - 1`` that depends on the pair and the seed alone.

    Unlike a random split it gives the same answer for any partitioning, after a lost executor and in plain SQL.
    """
    prime = F.lit(_MODULUS).cast("long")
    first = F.pmod(F.col(user).cast("long") * F.lit(_USER_STEP) + F.lit(int(seed)), prime)
    second = F.pmod((first + F.col(item).cast("long")) * F.lit(_ITEM_STEP), prime)
    return F.pmod(second * F.lit(_USER_STEP) % prime, F.lit(SPLIT_BUCKETS).cast("long"))


def request_key(user: str, top_n: str, genre: str) -> Column:
    """Text that is equal for requests with the same answer; no genre and a blank genre both read ``all``."""
    wanted = F.lower(F.trim(F.col(genre)))
    return F.concat_ws(
        ":",
        F.concat(F.lit("user="), F.col(user).cast("string")),
        F.concat(F.lit("top="), F.col(top_n).cast("string")),
        F.concat(F.lit("genre="), F.when(wanted != "", wanted).otherwise(F.lit("all"))),
    )
