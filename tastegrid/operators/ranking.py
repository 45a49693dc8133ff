"""Numbering and cutting rows within groups, also where one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 64


def top_k(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_col: str = "rank",
    spread_by: Sequence[str] = (),
    colocated: bool = False,
) -> DataFrame:
    """The first ``k`` rows of every group in ``order``, numbered from 1.

    Spark cuts each group to ``k`` rows before the shuffle, so a hot group costs a task at most ``k`` rows per input
    partition.  That pre-cut is lost for ``k`` above the session's limit and where the input already lies together by
    a part of the key (``colocated``).  In those cases the group is first cut within ``SHARDS`` slices, told apart by
    the columns ``spread_by``, and the survivors are ranked.  The result is the same rows either way.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if spread_by and (colocated or k > limit):
        slices = Window.partitionBy(*by, "_shard").orderBy(*order)
        df = (
            df.withColumn("_shard", F.pmod(F.xxhash64(*spread_by), F.lit(SHARDS)))
            .withColumn("_place", F.row_number().over(slices))
            .filter(F.col("_place") <= k)
            .drop("_shard", "_place")
        )
    groups = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(groups)).filter(F.col(rank_col) <= k)
