"""Acceptance checks on incoming feedback and behaviour events.

Both flag rows instead of dropping them, so accepted and rejected rows come from the same single pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.config import EVENT_TYPES
from tastegrid.functions import on_scale


def rating_gate(feedback: DataFrame) -> DataFrame:
    """Add ``accepted``: the rating is on the scale."""
    return feedback.withColumn("accepted", on_scale())


def event_gate(events: DataFrame) -> DataFrame:
    """Normalise ``event_type`` and add ``accepted``: the type is one of the known ones."""
    normal = events.withColumn("event_type", F.lower(F.trim("event_type")))
    return normal.withColumn("accepted", F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)))


def accepted_rows(gated: DataFrame) -> DataFrame:
    return gated.filter("accepted").drop("accepted")


def rejected_rows(gated: DataFrame) -> DataFrame:
    return gated.filter("NOT accepted").drop("accepted")


def rating_to_event(feedback: DataFrame) -> DataFrame:
    """The ``rate`` event that every accepted rating also raises, stamped in UTC."""
    # Arithmetic without a time zone, so that the session's zone does not matter.
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    stamp = epoch + F.make_dt_interval(secs=F.col("ts").cast("decimal(18,6)"))
    return accepted_rows(rating_gate(feedback)).select(
        stamp.cast("string").alias("timestamp"),
        F.lit("rate").alias("event_type"),
        "user_id",
        "item_id",
        F.create_map(F.lit("rating"), F.col("rating").cast("string")).alias("metadata"),
    )
