"""Reproducible train/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.config import SplitConfig
from tastegrid.functions import split_bucket
from tastegrid.functions.keys import SPLIT_BUCKETS


def with_split(ratings: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Add ``is_test``; all ratings of one (user, item) pair fall on the same side."""
    limit = round(config.test_share * SPLIT_BUCKETS)
    return ratings.withColumn("is_test", split_bucket("user_id", "item_id", config.seed) < limit)


def train_test(ratings: DataFrame, config: SplitConfig = SplitConfig()) -> tuple[DataFrame, DataFrame]:
    marked = with_split(ratings, config)
    return marked.filter("NOT is_test").drop("is_test"), marked.filter("is_test").drop("is_test")
