"""Profile ratings kept up to date from a stream of writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tastegrid.operators.profiles import ensure_item_stub, latest_profile_rating

WRITE_COLUMNS = ("profile_id", "item_id", "rating", "source", "rated_at", "write_no")


def stream_profile_ratings(
    writes: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append the last write per key of each micro-batch to the change log at ``path``.

    Each micro-batch owns the folder ``batch_id=<n>`` and overwrites it when replayed, so a restart never repeats
    writes.  ``current_profile_ratings`` merges the log on reading.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        entry = F.struct(*[c for c in WRITE_COLUMNS if c not in ("profile_id", "item_id")])
        order = F.struct("rated_at", "write_no", "rating")
        last = batch.groupBy("profile_id", "item_id").agg(F.max_by(entry, order).alias("last"))
        flat = last.select("profile_id", "item_id", "last.*").select(*WRITE_COLUMNS)
        flat.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = writes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_profile_ratings(log: DataFrame) -> DataFrame:
    """The rating table that the change log amounts to."""
    return latest_profile_rating(log)


def items_with_stubs(items: DataFrame, log: DataFrame) -> DataFrame:
    """The catalogue with a placeholder for every item that profiles have rated and it does not list."""
    return ensure_item_stub(items, log)
