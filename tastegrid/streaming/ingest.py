"""Feedback and events stored by one streaming query each, with all outputs of a micro-batch visible together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from tastegrid.operators.gates import accepted_rows, rating_to_event, rejected_rows
from tastegrid.operators.profiles import latest_profile_rating
from tastegrid.sources.batches import KeyedStore, read_batches, write_batch
from tastegrid.streaming.feeds import settled_feedback, stamped_events, stamped_feedback
from tastegrid.streaming.upserts import WRITE_COLUMNS

RATING = "user_id int, item_id int, rating double, ts long"
EVENT = "timestamp string, event_type string, user_id int, item_id int, metadata map<string,string>, dt string"
PROFILE_WRITE = "profile_id long, item_id int, rating double, source string, rated_at long, write_no long"
#: The outputs of the two queries.
RATINGS, LATE, REJECTED, RATE_EVENTS = "ratings", "late", "rejected", "rate_events"
ACCEPTED_EVENTS, REJECTED_EVENTS = "events", "rejected_events"


def _start(rows: DataFrame, store, checkpoint: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_deliveries(feedback: DataFrame, repeat_within: str) -> DataFrame:
    """Stamped and gated feedback with ``arrived_at``; a rating that is delivered again, equal in user, item, rating and
    time, within the delay is left out.

    The state is kept by time of **arrival**, which Spark fixes per micro-batch and repeats when a batch is replayed. It
    never lies behind the watermark as long as the driver's clock is not set back by more than the delay, so no rating is
    dropped for being old; the state holds the keys of one delay.
    """
    arrived = stamped_feedback(feedback).withColumn("arrived_at", F.current_timestamp())
    arrived = arrived.withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    return arrived.withWatermark("arrived_at", repeat_within).dropDuplicatesWithinWatermark(["user_id", "item_id", "rating", "ts"])


def ingest_feedback(
    feedback: DataFrame, root: str, checkpoint: str, repeat_within: str = "1 hour", late_after: int = 7 * 86400, once: bool = False
) -> StreamingQuery:
    """Store ratings, the ``rate`` events that they raise, and rejected rows, in one query.

    Each micro-batch writes all outputs and then its marker (``sources.batches``): after a restart anywhere in between it
    is written again as a whole, with the same stamps, so a rating and its event have one time and neither is lost or
    repeated. Ratings whose own time lies more than ``late_after`` seconds before their arrival are stored like all others
    and listed in the output ``late`` besides. ``feedback_store`` has one row per (user, item, ts), whatever was repeated
    beyond the delay.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = accepted_rows(rows)
            late = good.filter(F.unix_timestamp("arrived_at") - F.col("ts") > late_after)
            events = accepted_rows(stamped_events(rating_to_event(rows.drop("accepted", "arrived_at"))))
            outputs = {
                RATINGS: settled_feedback(good),
                LATE: late.select("user_id", "item_id", "rating", "ts"),
                REJECTED: rejected_rows(rows).select("user_id", "item_id", "rating", "ts"),
                RATE_EVENTS: events,
            }
            write_batch(rows.sparkSession, root, batch_id, outputs, {RATE_EVENTS: "dt"})
        finally:
            rows.unpersist()

    return _start(first_deliveries(feedback, repeat_within), store, checkpoint, once)


def feedback_store(root: str) -> KeyedStore:
    """The ratings that ``ingest_feedback`` has stored, one per (user, item, ts): the highest."""
    return KeyedStore(root, RATINGS, RATING, ("user_id", "item_id", "ts"), settled_feedback, shared=True)


def ingested(spark: SparkSession, root: str, output: str) -> DataFrame:
    """An output of ``ingest_feedback`` or ``ingest_events`` as far as its batches are committed; ratings once per key."""
    if output == RATINGS:
        return feedback_store(root).read(spark)
    kind = EVENT if output in (RATE_EVENTS, ACCEPTED_EVENTS, REJECTED_EVENTS) else RATING
    return read_batches(spark, root, output, kind).drop("batch_id")


def ingest_events(events: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Store accepted events by day and rejected ones apart: the source is read and gated once, and both outputs of a
    micro-batch become visible together."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            outputs = {ACCEPTED_EVENTS: accepted_rows(rows), REJECTED_EVENTS: rejected_rows(rows)}
            write_batch(rows.sparkSession, root, batch_id, outputs, dict.fromkeys(outputs, "dt"))
        finally:
            rows.unpersist()

    return _start(stamped_events(events), store, checkpoint, once)


# Profile ratings -----------------------------------------------------------------------------------------------------


def last_writes(writes: DataFrame) -> DataFrame:
    """The last write per (profile, item) with its order, so that it can be merged again."""
    entry = F.struct(*[c for c in WRITE_COLUMNS if c not in ("profile_id", "item_id")])
    last = writes.groupBy("profile_id", "item_id").agg(F.max_by(entry, F.struct("rated_at", "write_no", "rating")).alias("last"))
    return last.select("profile_id", "item_id", "last.*").select(*WRITE_COLUMNS)


def profile_rating_store(root: str) -> KeyedStore:
    return KeyedStore(root, "profile_ratings", PROFILE_WRITE, ("profile_id", "item_id"), last_writes)


def keep_profile_ratings(writes: DataFrame, root: str, checkpoint: str, compact_every: int = 100, once: bool = False) -> StreamingQuery:
    """Keep the profile rating table up to date from a stream of writes, and merge its log into a snapshot every so many
    batches: reading it (``current_ratings``) does not grow with the log's age."""
    kept = profile_rating_store(root)

    def store(batch: DataFrame, batch_id: int) -> None:
        kept.append(batch.select(*WRITE_COLUMNS), batch_id)
        if (batch_id + 1) % compact_every == 0:
            kept.compact(batch.sparkSession)

    return _start(writes, store, checkpoint, once)


def current_ratings(spark: SparkSession, root: str) -> DataFrame:
    return latest_profile_rating(profile_rating_store(root).read(spark))
