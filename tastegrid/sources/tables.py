"""The silver and gold tables (parquet), models and training records."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tastegrid.config import USER_BUCKETS
from tastegrid.functions import user_bucket
from tastegrid.operators.serving import BUCKET_COUNT, bucket_count, of_users
from tastegrid.schemas import FALLBACK, ITEMS, PRECOMPUTED, SILVER_RATINGS, TRIALS

in_buckets_of = of_users


def _absent(error: AnalysisException) -> bool:
    return (error.getCondition() or "").startswith(("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def _write_by_user_bucket(df: DataFrame, path: str, buckets: int) -> None:
    """Overwrite ``path`` with one folder per user bucket, and note the number of buckets beside them.

    Rebalancing gathers each bucket in few files of even size, and splits a bucket that holds far more rows than the
    others over several tasks.  Rows are sorted by user within a file, which makes row-group filters on it selective.
    """
    gathered = df.hint("rebalance", "user_bucket").sortWithinPartitions("user_bucket", "user_id")
    gathered.write.mode("overwrite").partitionBy("user_bucket").parquet(path)
    # Readers of the table skip names that begin with an underscore.
    df.sparkSession.range(1).select(F.lit(int(buckets)).alias("buckets")).write.mode("overwrite").parquet(f"{path}/_buckets")


def _read_by_user_bucket(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table; its ``user_bucket`` column knows the number of buckets if the writer noted it."""
    table = spark.read.schema(schema).parquet(path)
    try:
        buckets = spark.read.schema("buckets int").parquet(f"{path}/_buckets").head()["buckets"]
    except AnalysisException as error:
        if not _absent(error):
            raise
        return table
    return table.withMetadata("user_bucket", {BUCKET_COUNT: buckets})


def write_silver_ratings(ratings: DataFrame, path: str, buckets: int = USER_BUCKETS) -> None:
    _write_by_user_bucket(ratings.withColumn("user_bucket", user_bucket(buckets=buckets)), path, buckets)


def read_silver_ratings(spark: SparkSession, path: str) -> DataFrame:
    return _read_by_user_bucket(spark, path, SILVER_RATINGS)


def write_silver_items(items: DataFrame, path: str) -> None:
    items.select(*ITEMS.names).write.mode("overwrite").parquet(path)


def read_silver_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS).parquet(path)


def write_gold_fallback(fallback: DataFrame, path: str) -> None:
    # A few rows per genre: rebalancing leaves one small file.
    fallback.select(*FALLBACK.names).hint("rebalance").write.mode("overwrite").parquet(path)


def read_gold_fallback(spark: SparkSession, path: str, rebuild: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The stored fallback lists; a table that is missing or cannot be read is rebuilt and stored if ``rebuild`` is given."""
    try:
        stored = spark.read.schema(FALLBACK).parquet(path)
        if rebuild is not None:
            # A few rows per genre, read once in full, so that a damaged file shows here and not in an answer.
            stored.write.format("noop").mode("overwrite").save()
    except (PySparkException, Py4JJavaError) as error:
        if rebuild is None:
            raise
        logging.getLogger(__name__).warning("rebuilding the fallback lists at %s: %s", path, str(error)[:200])
        write_gold_fallback(rebuild(), path)
        stored = spark.read.schema(FALLBACK).parquet(path)
    return stored


def write_gold_precomputed(recommendations: DataFrame, path: str, buckets: int = USER_BUCKETS) -> None:
    _write_by_user_bucket(recommendations.select(*PRECOMPUTED.names[:-1]).withColumn("user_bucket", user_bucket(buckets=buckets)), path, buckets)


def read_gold_precomputed(spark: SparkSession, path: str) -> DataFrame:
    return _read_by_user_bucket(spark, path, PRECOMPUTED)


def for_user(table: DataFrame, user_id: int) -> DataFrame:
    """One user's rows; of a table that knows its number of buckets all other folders are skipped."""
    mine, buckets = table.filter(F.col("user_id") == int(user_id)), bucket_count(table)
    return mine if buckets is None else mine.filter(F.col("user_bucket") == int(user_id) % buckets)


# Models and records --------------------------------------------------------------------------------------------------


def _utc_now() -> datetime:
    return datetime.now(timezone.utc)


def save_model_version(model: ALSModel, root: str, spark: SparkSession) -> str:
    """Store the model as a version of its own, then point the marker at it; readers follow the marker.

    Versions never overwrite each other, and until the marker is switched readers see the version before.
    """
    version = f"model-{_utc_now():%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    version_path = f"{root}/versions/{version}"
    model.save(version_path)
    marker = spark.range(1).select(F.lit(version).alias("version"), F.lit(version_path).alias("path"))
    marker.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/latest")
    return version_path


def latest_version(spark: SparkSession, root: str) -> DataFrame:
    """The marker's newest row: ``version, path, saved_at``; versions are named by time, which tells equal stamps apart."""
    markers = spark.read.schema("version string, path string, saved_at timestamp").parquet(f"{root}/latest")
    return markers.agg(F.max_by(F.struct("version", "path", "saved_at"), F.struct("saved_at", "version")).alias("m")).select("m.*")


def load_als_model(root: str) -> ALSModel | None:
    """The newest stored model, or None if none was ever stored; any other failure is the caller's to see."""
    spark = SparkSession.active()
    try:
        path = latest_version(spark, root).head()["path"]
    except AnalysisException as error:
        if not _absent(error):
            raise
        return None
    return ALSModel.load(path) if path is not None else None


def trial_rows(spark: SparkSession, trials: list[dict], run_id: str = "") -> DataFrame:
    """One row per trial of a parameter grid, marked with the run that made it; later runs have greater ids."""
    ordered = [(run_id, *(trial[name] for name in TRIALS.names[1:])) for trial in trials]
    return spark.createDataFrame(ordered, TRIALS)


def append_trials(trials: DataFrame, path: str) -> None:
    trials.select(*TRIALS.names).hint("rebalance").write.mode("append").parquet(path)


def stamped_metrics(metrics: DataFrame, algorithm: str, at: Column | None = None) -> DataFrame:
    stamp = F.current_timestamp() if at is None else at
    return metrics.select(stamp.alias("timestamp_utc"), F.lit(algorithm).alias("algorithm"), *metrics.columns)


def append_ranking_metrics(metrics: DataFrame, path: str, algorithm: str = "hybrid_rerank") -> None:
    stamped_metrics(metrics, algorithm).hint("rebalance").write.mode("append").parquet(path)
