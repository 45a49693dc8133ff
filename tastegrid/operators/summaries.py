"""Summaries of stored training and evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_trial(trials: DataFrame, all_runs: bool = False) -> DataFrame:
    """The trial with the lowest error (the first among equals) and the number of trials, as one row.

    Only the latest run counts, unless ``all_runs`` are asked for: older runs were fitted on other data.
    """
    if not all_runs:
        trials = trials.filter(F.col("run_id") == trials.agg(F.max("run_id")).scalar())
    scored = trials.filter(F.col("rmse").isNotNull())
    entry = F.struct("rank", "reg_param", "max_iter", "rmse")
    return scored.agg(
        F.min_by(entry, F.struct("rmse", "trial_no")).alias("best"), F.count(F.lit(1)).alias("trial_count")
    ).select(
        F.col("best.rmse").alias("best_rmse"),
        "best.rank",
        "best.reg_param",
        "best.max_iter",
        "trial_count",
    )


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The metrics row with the latest time stamp, as one row."""
    entry = F.struct(*metrics.columns)
    return metrics.agg(F.max_by(entry, F.col("timestamp_utc")).alias("last")).select("last.*")
