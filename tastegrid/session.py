"""Session-level settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

# A skewed join partition is split even when that costs one more shuffle above the join: several operators rank rows
# per user right after a join on the user, and a user may own a large share of all rows.
# Shuffled rows are compressed and grow many times over where they are sorted, so tasks take less than Spark's 64 MB each:
# a task's memory then does not grow with the input up to that size, and sorts need not spill.
# Files of repeated words and small numbers are a tenth or less of the rows in them: by its file's size a table of a million
# items would be broadcast, which takes the driver's memory for each of its joins.
SKEW_SETTINGS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.fileCompressionFactor": "10.0",
}


def apply_session_settings(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings the operators count on; everything else stays the caller's choice."""
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def placed_by_part(spark: SparkSession) -> Iterator[None]:
    """Joins planned meanwhile accept sides that both lie by a part of the join key, instead of shuffling them by all of it."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder, if one is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder.

    Where none is configured, a temporary folder serves a local master (tests); on a cluster that is an error, because
    executors would write to folders that nobody else can read.
    """
    root = shared_dir(spark)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return f"{tempfile.mkdtemp(prefix='tastegrid-')}/{name}"
    return "/".join([root.rstrip("/"), f"tastegrid-{uuid.uuid4().hex}", name])


def reuse(df: DataFrame) -> DataFrame:
    """Keep ``df`` for several later jobs: written once to the shared folder and read back, else a spillable cache.

    Losing executors then costs at most a re-read (files) or a recomputation (cache) of the lost partitions.  Hand the
    result to ``release`` when it is no longer needed.
    """
    spark = df.sparkSession
    if shared_dir(spark) is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = scratch_path(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Free what ``reuse`` kept for ``df``; a plain DataFrame is left alone."""
    df.unpersist()
    root = shared_dir(df.sparkSession)
    files = [] if root is None else df.inputFiles()
    if files and "/tastegrid-" in files[0] and files[0].split("/")[-2] == "kept":
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
