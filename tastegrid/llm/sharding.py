"""A two-pass external shuffle: scatter rows into memory-sized buckets, then shuffle each bucket and write it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import fresh
from tastegrid.session import scratch_path


@dataclass(frozen=True)
class ShuffleConfig:
    shards: int = 8
    seed: int = 17
    bucket_bytes: int = 16 << 20


def row_bytes(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def _shuffled(seed: int, bucket: str, planned: str, position: str):
    def shuffle(table: pa.Table) -> pa.Table:
        number, want = table.column(bucket)[0].as_py(), table.column(planned)[0].as_py()
        if table.num_rows != want:
            raise ValueError(f"bucket {number} has {table.num_rows} rows, {want} were counted: the input changed between two reads")
        # Generator.shuffle is the Fisher-Yates shuffle.
        order = np.arange(table.num_rows)
        np.random.Generator(np.random.PCG64([seed, number])).shuffle(order)
        where = table.schema.get_field_index(position)
        base = table.column(position)
        table = table.take(pa.array(order))
        return table.set_column(where, position, pa.array(np.arange(len(order)) + base[0].as_py(), pa.int64()))

    return shuffle


def external_shuffle(docs: DataFrame, config: ShuffleConfig = ShuffleConfig(), text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``shard`` and ``slot``: one seeded permutation of the rows, cut into equal shards.

    Pass one scatters rows evenly over ``total bytes / bucket_bytes`` buckets by a seeded hash of the row's place in the
    input, so that equal rows or a hot key spread like all others. Pass two shuffles each bucket in memory. The shuffled
    buckets, one after the other, are the permutation; shard ``s`` is its ``s``-th run, and shard sizes differ by one row
    at most. ``slot`` counts from 0 within the shard.

    The place in the input is the same in every read of the same files with the same split settings; a task that runs
    again after a lost executor gives the same rows, and a differing read is an error, never a wrong result. Null texts,
    empty texts, null ids and repeated rows are rows like others. A text longer than ``bucket_bytes`` makes its bucket
    longer. An empty table gives no rows. Columns named ``shard`` or ``slot`` in the input are replaced.
    """
    docs = docs.drop("shard", "slot")
    bucket, planned, position = (fresh(docs.columns, c) for c in ("bucket", "planned", "position"))
    total = docs.agg(F.coalesce(F.sum(row_bytes(text)), F.lit(0)).alias("n")).head()["n"]
    count = max(1, -(-total // config.bucket_bytes))
    placed = docs.withColumn(bucket, F.pmod(F.xxhash64(F.lit(config.seed), F.monotonically_increasing_id()), F.lit(count)))
    # Without the texts: one number per bucket, known before the texts move.
    sizes = placed.groupBy(bucket).agg(F.count("*").alias(planned))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(position, F.coalesce(F.sum(planned).over(before), F.lit(0)))
    all_rows = docs.count()
    if not all_rows:
        return docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).limit(0)
    joined = placed.join(starts, bucket)
    mixed = joined.groupBy(bucket).applyInArrow(_shuffled(config.seed, bucket, planned, position), joined.schema)
    # Shard s holds the positions from ceil(s * rows / shards) on.
    shard = F.expr(f"cast({position} * {config.shards} div {all_rows} as int)")
    first = F.expr(f"(shard * {all_rows}L + {config.shards - 1}) div {config.shards}")
    return mixed.withColumn("shard", shard).withColumn("slot", F.col(position) - first).drop(bucket, planned, position)


def write_shards(docs: DataFrame, path: str, config: ShuffleConfig = ShuffleConfig(), text: str = "text") -> DataFrame:
    """Write the shuffled rows, one folder per shard, and return them as stored; within a shard ``slot`` is the order."""
    shuffled = external_shuffle(docs, config, text)
    shuffled.write.partitionBy("shard").parquet(path)
    schema = shuffled.drop("shard").withColumn("shard", F.lit(0)).schema
    return docs.sparkSession.read.schema(schema).parquet(path)


def shuffled_shards(docs: DataFrame, config: ShuffleConfig = ShuffleConfig()) -> DataFrame:
    """Digest of the written shards: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    written = write_shards(docs.select("doc_id", "text"), scratch_path(docs.sparkSession, "shards"), config)
    return written.select(
        "doc_id",
        row_bytes().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
