"""Keeping joins splittable where one key owns a large share of the rows.

Adaptive execution splits a skewed join partition only if both inputs were shuffled for that very join.  The small side
is often an aggregate by the join key, which already lies the way the join wants it, so it would not be shuffled again
and the large side could not be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


#: The extra column by which rows are placed beside their keys.
MARK = "_beside"


def _beside(*keys: str) -> Column:
    return F.xxhash64(*keys).alias(MARK)


def group_for_join(df: DataFrame, *keys: str) -> GroupedData:
    """``groupBy(*keys)`` for an aggregate that is joined by these keys afterwards.

    The groups are the same, since the extra grouping column is a function of the keys; but the join shuffles the
    (small) result anew and can then split the other side.  Select the wanted columns from the result.  Rows that
    ``matching`` placed by the keys and gave back with their mark are grouped where they lie.
    """
    return df.groupBy(MARK, *keys) if MARK in df.columns else df.groupBy(*keys, _beside(*keys))


def distinct_for_join(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys, to be joined by them; see ``group_for_join``."""
    return df.select(*keys, _beside(*keys)).distinct().select(*keys)


def matching(df: DataFrame, wanted: DataFrame, *keys: str, marked: bool = False) -> DataFrame:
    """The rows of ``df`` whose keys occur in ``wanted``, to be grouped and joined by them; see ``group_for_join``.

    ``marked`` rows keep the column they were placed by, so that grouping them does not shuffle them once more.
    """
    asked = wanted.select(*keys, _beside(*keys)).distinct()
    found = df.withColumn(MARK, _beside(*keys)).join(asked, [MARK, *keys], "left_semi")
    return found if marked else found.drop(MARK)
