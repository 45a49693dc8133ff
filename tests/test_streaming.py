from pyspark.sql import functions as F

from tastegrid.operators import gates
from tastegrid.streaming import feeds, upserts
from tests.helpers import tuples


def drain(started):
    for running in started if isinstance(started, tuple) else (started,):
        running.awaitTermination()


def test_events_arrive_once(spark, tmp_path):
    root = str(tmp_path)
    lines = [
        '{"timestamp":"2024-01-01T10:00:00","event_type":" Click ","user_id":1,"item_id":2,"metadata":{"a":"b"}}',
        '{"timestamp":"2024-01-02T10:00:00","event_type":"view","user_id":1}',
        '{"timestamp":"2024-01-02T10:00:00","event_type":"buy","user_id":1}',
        '{"event_type":"rate","user_id":3}',
    ]
    (tmp_path / "in").mkdir()

    def run():
        source = feeds.event_source(spark, f"{root}/in")
        drain(feeds.stream_event_sink(source, f"{root}/out", f"{root}/bad", f"{root}/state", once=True))

    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    run()
    run()
    stored = spark.read.parquet(f"{root}/out")
    assert stored.count() == 3 and spark.read.parquet(f"{root}/bad").count() == 1
    (tmp_path / "in" / "b.json").write_text(lines[1])
    run()
    stored = spark.read.parquet(f"{root}/out").withColumn("dt", F.col("dt").cast("string"))
    known = stored.filter("user_id = 1")
    assert tuples(known, "event_type", "item_id", "dt") == [
        ("click", 2, "2024-01-01"),
        ("view", None, "2024-01-02"),
        ("view", None, "2024-01-02"),
    ]
    undated = stored.filter("user_id = 3").head()
    assert undated.timestamp[:10] == undated.dt and undated.metadata == {}


def test_feedback_stream_equals_its_batch_twin(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "in").mkdir()
    header = "userId,movieId,rating,timestamp\n"
    (tmp_path / "in" / "a.csv").write_text(header + "1,1,4.0,100\n1,1,4.0,100\n2,1,9.0,100\n")
    (tmp_path / "in" / "b.csv").write_text(header + "1,1,4.0,100\n3,1,0.5,200\n")
    for _ in range(2):
        source = feeds.feedback_source(spark, f"{root}/in")
        drain(feeds.stream_feedback_sink(source, f"{root}/out", f"{root}/bad", f"{root}/state", once=True))
    delivered = spark.read.parquet(f"{root}/out")
    assert delivered.count() == 4
    good = feeds.settled_feedback(delivered)
    assert tuples(good) == [(1, 1, 4.0, 100), (3, 1, 0.5, 200)]
    assert tuples(spark.read.parquet(f"{root}/bad")) == [(2, 1, 9.0, 100)]
    batch = spark.read.schema(good.schema).option("header", True).csv(f"{root}/in")
    assert tuples(gates.accepted_rows(gates.rating_gate(batch)).distinct()) == tuples(good)


def test_late_ratings_are_kept(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "in").mkdir()
    header = "userId,movieId,rating,timestamp\n"
    for name, line in (("a", "1,1,4.0,10000000\n"), ("b", "2,1,3.0,9000000\n1,1,4.5,10000000\n")):
        (tmp_path / "in" / f"{name}.csv").write_text(header + line)
        source = feeds.feedback_source(spark, f"{root}/in")
        drain(feeds.stream_feedback_sink(source, f"{root}/out", f"{root}/bad", f"{root}/state", once=True))
    stored = spark.read.parquet(f"{root}/out")
    assert stored.count() == 3
    assert tuples(feeds.settled_feedback(stored)) == [(1, 1, 4.5, 10000000), (2, 1, 3.0, 9000000)]
    source = feeds.feedback_source(spark, f"{root}/in")
    drain(feeds.stream_rating_events(source, f"{root}/events", f"{root}/no_events", f"{root}/event_state", once=True))
    raised = spark.read.parquet(f"{root}/events").select("user_id", "event_type", F.col("dt").cast("string").alias("dt"))
    assert tuples(raised) == [(1, "rate", "1970-04-26"), (1, "rate", "1970-04-26"), (2, "rate", "1970-04-15")]


def test_days_are_read_from_the_stamp(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stamps = ["2024-01-01T23:30:00-05:00", "2024-01-01T10:00:00", "junk/../../x"]
    lines = [f'{{"timestamp":"{s}","event_type":"view","user_id":{i}}}' for i, s in enumerate(stamps)]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    root = str(tmp_path)
    drain(feeds.stream_event_sink(feeds.event_source(spark, f"{root}/in"), f"{root}/out", f"{root}/bad", f"{root}/state", once=True))
    stored = spark.read.parquet(f"{root}/out").withColumn("dt", F.col("dt").cast("string"))
    assert tuples(stored, "user_id", "dt") == [(0, "2024-01-02"), (1, "2024-01-01")]
    assert tuples(spark.read.parquet(f"{root}/bad"), "user_id", "dt") == [(2, "unknown")]


def test_profile_ratings_replay(spark, tmp_path, rows):
    root = str(tmp_path)
    schema = "profile_id long, item_id int, rating double, source string, rated_at long, write_no long"

    def deliver(*values):
        rows(schema, *values).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(schema).parquet(f"{root}/in")
        drain(upserts.stream_profile_ratings(source, f"{root}/log", f"{root}/state", once=True))

    deliver((1, 1, 3.0, "ui", 1, 1), (1, 1, 4.0, "ui", 1, 2), (1, 2, 5.0, "ui", 1, 1))
    deliver((1, 1, 2.0, "ui", 2, 1))
    log = spark.read.parquet(f"{root}/log")
    assert log.count() == 3
    assert tuples(upserts.current_profile_ratings(log), "item_id", "rating") == [(1, 2.0), (2, 5.0)]
    catalogue = rows("item_id int, title string, genres string", (1, "A", "x"))
    assert tuples(upserts.items_with_stubs(catalogue, log), "item_id", "title") == [(1, "A"), (2, "Unknown")]
