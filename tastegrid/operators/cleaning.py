"""Typed, range-checked, de-duplicated ratings and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.config import USER_BUCKETS
from tastegrid.functions import on_scale, user_bucket
from tastegrid.operators.skew import group_for_join
from tastegrid.schemas import ITEMS, RATINGS

RATING_KEY = ("user_id", "item_id", "ts")


def _typed(df: DataFrame, schema) -> DataFrame:
    """Only the schema's columns in its types; a value that does not fit becomes null."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def _usable_rating(require_ts: bool) -> Column:
    usable = F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & on_scale()
    return usable & F.col("ts").isNotNull() if require_ts else usable


def _best_rating_per_key(usable: DataFrame) -> DataFrame:
    # An aggregate, not a row number: repeated writes of one key shrink before the shuffle.
    return usable.groupBy(*RATING_KEY).agg(F.max("rating").alias("rating")).select(*RATINGS.names)


def clean_ratings(raw: DataFrame, require_ts: bool = True) -> DataFrame:
    """Drop unusable rows and keep the highest rating of each (user, item, ts)."""
    return _best_rating_per_key(_typed(raw, RATINGS).filter(_usable_rating(require_ts)))


def with_user_bucket(df: DataFrame, buckets: int = USER_BUCKETS) -> DataFrame:
    return df.withColumn("user_bucket", user_bucket(buckets=buckets))


def merge_feedback(ratings: DataFrame, feedback: DataFrame | None) -> DataFrame:
    """Stored ratings together with collected feedback; a missing time stamp is allowed here."""
    both = _typed(ratings, RATINGS)
    if feedback is not None:
        both = both.unionByName(_typed(feedback, RATINGS))
    return _best_rating_per_key(both.filter(_usable_rating(require_ts=False)))


def clean_items(raw: DataFrame) -> DataFrame:
    """Drop incomplete items and keep one (title, genres) per item, the smallest."""
    complete = _typed(raw, ITEMS).dropna()
    return (
        group_for_join(complete, "item_id")
        .agg(F.min(F.struct("title", "genres")).alias("kept"))
        .select("item_id", "kept.title", "kept.genres")
    )


def _row_counts(keyed: DataFrame, keys: tuple[str, ...], table: str) -> DataFrame:
    # Unusable rows share the all-null key, which collapses before the shuffle.
    masked = keyed.select(F.col("usable"), *[F.when(F.col("usable"), F.col(k)).alias(k) for k in keys])
    per_key = masked.groupBy("usable", *keys).agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows"), F.lit(0))
    after = F.count_if("usable")
    return per_key.agg(
        F.lit(table).alias("table_name"),
        before.cast("long").alias("rows_before"),
        after.cast("long").alias("rows_after"),
        (before - after).cast("long").alias("rows_dropped"),
    )


def rating_row_counts(raw: DataFrame) -> DataFrame:
    """Rows before and after cleaning, from one scan."""
    typed = _typed(raw, RATINGS).withColumn("usable", _usable_rating(require_ts=True))
    return _row_counts(typed, RATING_KEY, "ratings")


def item_row_counts(raw: DataFrame) -> DataFrame:
    complete = F.col("item_id").isNotNull() & F.col("title").isNotNull() & F.col("genres").isNotNull()
    return _row_counts(_typed(raw, ITEMS).withColumn("usable", complete), ("item_id",), "items")


def clean_stats(raw_ratings: DataFrame, raw_items: DataFrame) -> DataFrame:
    return rating_row_counts(raw_ratings).unionByName(item_row_counts(raw_items))


# Cleaning and counting in one pass -----------------------------------------------------------------------------------


def rating_groups(raw: DataFrame) -> DataFrame:
    """Each (user, item, ts) with its highest rating and how many rows it stands for; unusable rows are one group.

    Clean rows (``cleaned_ratings``) and counts (``group_counts``) both follow from the groups, so a raw file that is read
    once gives both, and counts are data, which running a task again does not change.
    """
    typed = _typed(raw, RATINGS).withColumn("usable", _usable_rating(require_ts=True))
    masked = typed.select("usable", *[F.when(F.col("usable"), F.col(c)).alias(c) for c in RATINGS.names])
    return masked.groupBy("usable", *RATING_KEY).agg(F.max("rating").alias("rating"), F.count("*").alias("rows"))


def item_groups(raw: DataFrame) -> DataFrame:
    """Each item with its smallest (title, genres) and its number of rows; incomplete rows are one group."""
    complete = F.col("item_id").isNotNull() & F.col("title").isNotNull() & F.col("genres").isNotNull()
    typed = _typed(raw, ITEMS).withColumn("usable", complete)
    masked = typed.select("usable", *[F.when(F.col("usable"), F.col(c)).alias(c) for c in ITEMS.names])
    return masked.groupBy("usable", "item_id").agg(F.min(F.struct("title", "genres")).alias("kept"), F.count("*").alias("rows"))


def cleaned_ratings(groups: DataFrame) -> DataFrame:
    return groups.filter("usable").select(*RATINGS.names)


def cleaned_items(groups: DataFrame) -> DataFrame:
    return groups.filter("usable").select("item_id", "kept.title", "kept.genres")


def group_counts(groups: DataFrame, table: str) -> DataFrame:
    """Rows before and after cleaning, as ``clean_stats`` gives them."""
    before, after = F.coalesce(F.sum("rows"), F.lit(0)), F.count_if("usable")
    return groups.agg(
        F.lit(table).alias("table_name"),
        before.cast("long").alias("rows_before"),
        after.cast("long").alias("rows_after"),
        (before - after).cast("long").alias("rows_dropped"),
    )
