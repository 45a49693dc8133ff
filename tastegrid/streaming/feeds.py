"""Feedback ratings and behaviour events as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tastegrid.operators.gates import accepted_rows, event_gate, rating_gate, rating_to_event, rejected_rows
from tastegrid.schemas import EVENTS, RATINGS

EVENT_COLUMNS = EVENTS.names


def event_source(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON lines."""
    return spark.readStream.schema(EVENTS).json(folder)


def feedback_source(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings as CSV with header."""
    return spark.readStream.schema(RATINGS).option("header", True).csv(folder)


def stamped_events(events: DataFrame) -> DataFrame:
    """Events with their UTC time stamp (now, if they carry none), its day, and the gate's verdict."""
    stamped = events.withColumn("_at", F.try_to_timestamp("timestamp"))
    gated = event_gate(stamped)
    # A time stamp that is there but cannot be read rejects the event.
    gated = gated.withColumn("accepted", F.col("accepted") & (F.col("timestamp").isNull() | F.col("_at").isNotNull()))
    utc_now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    now = F.concat(F.date_format(utc_now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    stamp = F.coalesce(F.col("timestamp"), now)
    # The day in UTC, whatever offset the stamp carries; unreadable stamps lie under "unknown".
    read = F.to_utc_timestamp(F.coalesce("_at", F.when(F.col("timestamp").isNull(), F.current_timestamp())), F.current_timezone())
    day = F.coalesce(F.date_format(read, "yyyy-MM-dd"), F.lit("unknown"))
    metadata = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    return gated.withColumns({"timestamp": stamp, "metadata": metadata, "dt": day}).drop("_at")


def stamped_feedback(feedback: DataFrame) -> DataFrame:
    """Ratings with epoch seconds (now, if they carry none) and the gate's verdict."""
    now = F.unix_timestamp(F.current_timestamp())
    return rating_gate(feedback.withColumn("ts", F.coalesce("ts", now)))


def settled_feedback(stored: DataFrame) -> DataFrame:
    """Stored ratings once each: of repeated deliveries of one (user, item, ts) the highest rating counts."""
    return stored.groupBy("user_id", "item_id", "ts").agg(F.max("rating").alias("rating")).select("user_id", "item_id", "rating", "ts")


def _file_sink(rows: DataFrame, path: str, checkpoint: str, partition: str | None, once: bool) -> StreamingQuery:
    # The file sink commits each micro-batch in its log, so a restart neither loses nor repeats rows.
    writer = rows.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    if partition:
        writer = writer.partitionBy(partition)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_event_sink(
    events: DataFrame, path: str, rejected_path: str, checkpoint: str, once: bool = False
) -> tuple[StreamingQuery, StreamingQuery]:
    """Store accepted events by day, and rejected ones apart."""
    gated = stamped_events(events)
    return (
        _file_sink(accepted_rows(gated), path, f"{checkpoint}/accepted", "dt", once),
        _file_sink(rejected_rows(gated), rejected_path, f"{checkpoint}/rejected", "dt", once),
    )


def stream_feedback_sink(
    feedback: DataFrame, path: str, rejected_path: str, checkpoint: str, once: bool = False
) -> tuple[StreamingQuery, StreamingQuery]:
    """Store every accepted rating as it was delivered, however late, and rejected ones apart.

    No state is held and nothing is dropped; ``settled_feedback`` merges repeated deliveries on reading.
    """
    gated = stamped_feedback(feedback)
    return (
        _file_sink(accepted_rows(gated), path, f"{checkpoint}/accepted", None, once),
        _file_sink(rejected_rows(gated), rejected_path, f"{checkpoint}/rejected", None, once),
    )


def stream_rating_events(
    feedback: DataFrame, path: str, rejected_path: str, checkpoint: str, once: bool = False
) -> tuple[StreamingQuery, StreamingQuery]:
    """Store the ``rate`` event that each accepted rating raises; a rating without a time is stamped now, as it is stored."""
    raised = rating_to_event(stamped_feedback(feedback).drop("accepted"))
    return stream_event_sink(raised, path, rejected_path, checkpoint, once)
