"""Batches, snapshots, history ids, and the streams that write them."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tastegrid.operators.profiles import history_last_n
from tastegrid.sources import batches
from tastegrid.sources import history as stored_history
from tastegrid.streaming import feeds, ingest
from tests.helpers import tuples

HEADER = "userId,movieId,rating,timestamp\n"


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def feedback(spark, tmp_path, **options):
    source = feeds.feedback_source(spark, str(tmp_path / "in"))
    query = ingest.ingest_feedback(source, str(tmp_path / "out"), str(tmp_path / "state"), once=True, **options)
    query.awaitTermination()
    return query


def outputs(spark, tmp_path):
    return {name: tuples(ingest.ingested(spark, str(tmp_path / "out"), name)) for name in (ingest.RATINGS, ingest.LATE, ingest.REJECTED)}


def test_two_deliveries_with_repeats_and_the_older_one_last(spark, tmp_path):
    put(tmp_path / "in", "a.csv", HEADER + "1,1,4.0,20000000\n1,1,4.0,20000000\n2,1,9.0,20000000\n5,1,,20000000\n")
    feedback(spark, tmp_path)
    put(tmp_path / "in", "b.csv", HEADER + "1,1,4.0,20000000\n3,1,0.5,10000000\n1,1,4.5,20000000\n")
    query = feedback(spark, tmp_path)
    found = outputs(spark, tmp_path)
    assert found[ingest.RATINGS] == [(1, 1, 4.5, 20000000), (3, 1, 0.5, 10000000)]
    assert found[ingest.REJECTED] == [(2, 1, 9.0, 20000000), (5, 1, None, 20000000)]
    # Everything is years old, and is listed as late besides being stored: each delivery that is not a mere repeat.
    assert found[ingest.LATE] == [(1, 1, 4.0, 20000000), (1, 1, 4.5, 20000000), (3, 1, 0.5, 10000000)]
    events = ingest.ingested(spark, str(tmp_path / "out"), ingest.RATE_EVENTS)
    assert tuples(events.select("user_id", F.col("metadata")["rating"])) == [(1, "4.0"), (1, "4.5"), (3, "0.5")]
    assert all(s["numRowsDroppedByWatermark"] == 0 for p in query.recentProgress for s in p["stateOperators"])


def test_repeats_beyond_the_delay_are_one_row_in_the_store(spark, tmp_path):
    root = str(tmp_path / "out")
    for name in "abc":
        put(tmp_path / "in", f"{name}.csv", HEADER + "1,1,4.0,100\n")
        feedback(spark, tmp_path, repeat_within="1 millisecond")
    raw = batches.read_batches(spark, root, ingest.RATINGS, ingest.RATING)
    assert raw.count() > 1 and tuples(ingest.ingested(spark, root, ingest.RATINGS)) == [(1, 1, 4.0, 100)]
    store = ingest.feedback_store(root)
    assert store.compact(spark) >= 0 and tuples(store.read(spark)) == [(1, 1, 4.0, 100)]
    assert ingest.ingested(spark, root, ingest.RATE_EVENTS).count() == raw.count()


def test_a_restart_between_two_outputs_neither_loses_nor_repeats(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "a.csv", HEADER + "1,1,4.0,\n2,1,3.0,100\n2,2,7.0,100\n")
    real = ingest.rating_to_event

    def broken(rows):
        return real(rows).withColumn("user_id", F.raise_error(F.lit("lost")).cast("int"))

    monkeypatch.setattr(ingest, "rating_to_event", broken)
    with pytest.raises(StreamingQueryException):
        feedback(spark, tmp_path)
    # The first outputs lie there, but nobody sees them.
    assert list((tmp_path / "out" / ingest.RATINGS).glob("batch_id=0/*.parquet"))
    assert outputs(spark, tmp_path) == {ingest.RATINGS: [], ingest.LATE: [], ingest.REJECTED: []}
    monkeypatch.setattr(ingest, "rating_to_event", real)
    feedback(spark, tmp_path)
    ratings = ingest.ingested(spark, str(tmp_path / "out"), ingest.RATINGS)
    assert tuples(ratings, "user_id", "rating") == [(1, 4.0), (2, 3.0)]
    assert outputs(spark, tmp_path)[ingest.REJECTED] == [(2, 2, 7.0, 100)]
    # A rating without a time and its event have one.
    events = ingest.ingested(spark, str(tmp_path / "out"), ingest.RATE_EVENTS)
    stamped = events.select("user_id", F.unix_timestamp(F.try_to_timestamp("timestamp")).alias("ts"))
    assert tuples(stamped) == tuples(ratings, "user_id", "ts")


def test_events_in_one_query(spark, tmp_path):
    lines = ['{"timestamp":"2024-01-01T10:00:00","event_type":" Click ","user_id":1}', '{"timestamp":"2024-01-02T10:00:00","event_type":"buy","user_id":2}']
    put(tmp_path / "in", "a.json", "\n".join(lines))
    for _ in range(2):
        query = ingest.ingest_events(feeds.event_source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
        query.awaitTermination()
    good, bad = (ingest.ingested(spark, str(tmp_path / "out"), n) for n in (ingest.ACCEPTED_EVENTS, ingest.REJECTED_EVENTS))
    assert tuples(good, "user_id", "event_type", "dt") == [(1, "click", "2024-01-01")]
    assert tuples(bad, "user_id", "event_type", "dt") == [(2, "buy", "2024-01-02")]


# Snapshots -----------------------------------------------------------------------------------------------------------


def test_compaction_keeps_the_rows_and_bounds_the_files(spark, tmp_path, rows):
    store = ingest.profile_rating_store(str(tmp_path))
    files = []
    for n in range(12):
        store.append(rows(ingest.PROFILE_WRITE, *[(p, 1, float(n % 5), "ui", n, p) for p in range(6)]), n)
        assert not store.append(rows(ingest.PROFILE_WRITE, (9, 9, 9.0, "x", 0, 0)), n)
        if n % 3 == 2:
            before = tuples(store.read(spark))
            opened = store.read(spark)
            assert store.compact(spark) == n and store.compact(spark) == n
            # A reader that began before the switch still finds its files.
            assert tuples(store.read(spark)) == tuples(opened) == before
            files.append(len(store.read(spark).inputFiles()))
    assert tuples(store.read(spark), "profile_id", "rating") == [(p, 1.0) for p in range(6)]
    assert max(files) <= files[0]
    assert batches.committed(spark, str(tmp_path)) == [9, 10, 11]
    assert len(list((tmp_path / "snapshots").iterdir())) == 2
    # A batch that a snapshot holds is not written again.
    assert not store.append(rows(ingest.PROFILE_WRITE, (9, 9, 9.0, "x", 0, 0)), 2)


def test_markers_of_shared_batches_are_folded(spark, tmp_path, rows):
    root = str(tmp_path)
    store = ingest.feedback_store(root)
    for n in range(9):
        outputs = {ingest.RATINGS: rows(ingest.RATING, (n % 4, 1, float(n % 5) + 1, 7)), ingest.LATE: rows(ingest.RATING, (n, 1, 1.0, 7))}
        assert batches.write_batch(spark, root, n, outputs)
        if n % 2:
            store.compact(spark)
    assert batches.committed(spark, root) == list(range(9))
    assert not any(batches.write_batch(spark, root, n, {}) for n in range(9))
    assert len([p for p in (tmp_path / "_commits").iterdir() if p.name.startswith("batch_id")]) <= 3
    assert len([p for p in (tmp_path / "_folded").iterdir() if p.name.startswith("upto")]) <= 2
    assert len([p for p in (tmp_path / "_snapshots").iterdir() if p.name.startswith("upto")]) == 2
    assert tuples(ingest.ingested(spark, root, ingest.LATE), "user_id") == [(n,) for n in range(9)]
    assert tuples(ingest.ingested(spark, root, ingest.RATINGS), "user_id", "rating") == [(0, 5.0), (1, 2.0), (2, 3.0), (3, 4.0)]


def test_a_compaction_that_fails_changes_nothing(spark, tmp_path, rows, monkeypatch):
    store = ingest.profile_rating_store(str(tmp_path))
    store.append(rows(ingest.PROFILE_WRITE, (1, 1, 2.0, "ui", 1, 1)), 0)
    folder = str(tmp_path / "snapshots" / "upto-0-broken")
    store.read(spark).write.parquet(folder)
    assert batches.snapshot(spark, str(tmp_path)) == (-1, None)
    assert tuples(store.read(spark)) == [(1, 1, 2.0, "ui", 1, 1)]
    assert store.compact(spark) == 0 and tuples(store.read(spark)) == [(1, 1, 2.0, "ui", 1, 1)]


def test_profile_ratings_as_a_stream(spark, tmp_path, rows):
    def deliver(*values):
        rows(ingest.PROFILE_WRITE, *values).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(ingest.PROFILE_WRITE).parquet(str(tmp_path / "in"))
        ingest.keep_profile_ratings(source, str(tmp_path / "store"), str(tmp_path / "state"), compact_every=2, once=True).awaitTermination()

    deliver((1, 1, 3.0, "ui", 1, 1), (1, 1, 4.0, "ui", 1, 2))
    deliver((1, 1, 2.0, "ui", 2, 1), (1, 2, 5.0, "ui", 1, 1))
    assert batches.snapshot(spark, str(tmp_path / "store"))[0] == 1
    deliver((1, 1, 1.0, "ui", 0, 9))
    assert tuples(ingest.current_ratings(spark, str(tmp_path / "store")), "item_id", "rating") == [(1, 2.0), (2, 5.0)]


# History -------------------------------------------------------------------------------------------------------------

ASKED = "request_id long, profile_id long, route string, top_n int, genre string, created_at timestamp"


def asked(rows, *ids):
    return rows(ASKED, *[(i, i % 3, "hybrid", 10, None, None) for i in ids])


def test_ids_go_on_and_replays_repeat_them(spark, tmp_path, rows, monkeypatch):
    path = str(tmp_path / "history")
    assert stored_history.append_history(asked(rows, 5, 3, 4), path, 0)
    first = asked(rows, *range(100, 160))
    # The second batch fails after its rows are written, before its marker.
    written = {}

    def torn(spark_, root, batch_id, outputs, **marks):
        outputs["history"].write.mode("overwrite").parquet(f"{root}/history/batch_id={batch_id}")
        written.update({r.request_id: r.history_id for r in outputs["history"].collect()})
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(stored_history, "write_batch", torn)
        with pytest.raises(RuntimeError):
            stored_history.append_history(first, path, 1)
    assert stored_history.read_history(spark, path).count() == 3
    assert stored_history.append_history(first.repartition(7), path, 1)
    assert not stored_history.append_history(first, path, 1)
    stored_history.append_history(asked(rows, 1), path, 2)
    stored = {r.request_id: r.history_id for r in stored_history.read_history(spark, path).collect()}
    assert stored == {3: 1, 4: 2, 5: 3, **{i: i - 96 for i in range(100, 160)}, 1: 64}
    assert {i: stored[i] for i in range(100, 160)} == written
    last = history_last_n(stored_history.read_history(spark, path), 2)
    assert tuples(last, "profile_id", "request_id", "place") == sorted([(0, 159, 1), (0, 156, 2), (1, 1, 1), (1, 157, 2), (2, 158, 1), (2, 155, 2)], key=str)


def test_history_of_no_rows(spark, tmp_path, rows):
    path = str(tmp_path / "history")
    assert stored_history.read_history(spark, path).count() == 0
    assert stored_history.append_history(asked(rows, 1).limit(0), path, 0)
    assert stored_history.append_history(asked(rows, 8), path, 1)
    assert [r.history_id for r in stored_history.read_history(spark, path).collect()] == [1]
