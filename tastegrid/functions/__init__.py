"""Column-level building blocks; all of them stay in the JVM."""

from tastegrid.functions.genres import genre_array, matches_genre, primary_genre, same_genre
from tastegrid.functions.keys import on_scale, request_key, split_bucket, user_bucket
from tastegrid.functions.scores import als_norm, comparable, discount, ideal_dcg, popularity, ratio_or_zero
from tastegrid.functions.text import release_year, title_without_year

__all__ = [
    "als_norm",
    "comparable",
    "discount",
    "genre_array",
    "ideal_dcg",
    "matches_genre",
    "on_scale",
    "popularity",
    "primary_genre",
    "ratio_or_zero",
    "release_year",
    "request_key",
    "same_genre",
    "split_bucket",
    "title_without_year",
    "user_bucket",
]
