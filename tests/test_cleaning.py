from tastegrid.operators import catalog, cleaning, gates
from tests.helpers import tuples


def test_clean_ratings_edges(ratings):
    raw = ratings(
        (None, 1, 3.0, 1),
        (1, None, 3.0, 1),
        (1, 1, None, 1),
        (1, 1, 3.0, None),
        (1, 2, 0.49, 1),
        (1, 3, 0.5, 1),
        (1, 4, 5.0, 1),
        (1, 5, 5.01, 1),
        (2, 1, 2.0, 9),
        (2, 1, 4.0, 9),
        (2, 1, 1.0, 10),
    )
    assert tuples(cleaning.clean_ratings(raw)) == [
        (1, 3, 0.5, 1),
        (1, 4, 5.0, 1),
        (2, 1, 1.0, 10),
        (2, 1, 4.0, 9),
    ]


def test_malformed_values_are_dropped_not_raised(rows):
    raw = rows("user_id string, item_id string, rating string, ts string", ("1", "2", "3.5", "4"), ("x", "2", "3", "4"))
    assert tuples(cleaning.clean_ratings(raw)) == [(1, 2, 3.5, 4)]


def test_merge_feedback_keeps_missing_time(ratings):
    stored, feedback = ratings((1, 1, 3.0, 5)), ratings((1, 1, 4.0, 5), (1, 1, 2.0, None), (2, 2, 9.0, 1))
    assert tuples(cleaning.merge_feedback(stored, feedback)) == [(1, 1, 2.0, None), (1, 1, 4.0, 5)]
    assert tuples(cleaning.merge_feedback(stored, None)) == [(1, 1, 3.0, 5)]


def test_clean_items(items):
    raw = items((1, "B", "x"), (1, "A", "z"), (1, "A", "y"), (2, None, "x"), (3, "C", None), (None, "D", "x"))
    assert tuples(cleaning.clean_items(raw)) == [(1, "A", "y")]


def test_clean_stats_counts_what_cleaning_keeps(ratings, items):
    raw = ratings((1, 1, 3.0, 1), (1, 1, 4.0, 1), (1, 1, 9.0, 1), (None, 1, 3.0, 1))
    raw_items = items((1, "A", "x"), (1, "B", "x"), (2, None, "x"))
    assert tuples(cleaning.clean_stats(raw, raw_items)) == [("items", 3, 1, 2), ("ratings", 4, 1, 3)]
    empty = cleaning.clean_stats(raw.filter("false"), raw_items.filter("false"))
    assert tuples(empty) == [("items", 0, 0, 0), ("ratings", 0, 0, 0)]


def test_rating_gate_and_event(ratings):
    gated = gates.rating_gate(ratings((1, 1, 3.0, 0), (1, 2, 0.0, 0), (1, 3, None, 0)))
    assert tuples(gates.accepted_rows(gated)) == [(1, 1, 3.0, 0)]
    assert len(tuples(gates.rejected_rows(gated))) == 2
    event = gates.rating_to_event(ratings((1, 1, 3.0, 0), (1, 2, 0.0, 0))).collect()
    assert [(e.timestamp, e.event_type, e.user_id, e.item_id, e.metadata) for e in event] == [
        ("1970-01-01 00:00:00", "rate", 1, 1, {"rating": "3.0"})
    ]


def test_event_gate(rows):
    gated = gates.event_gate(rows("event_type string", (" Click ",), ("view",), ("buy",), (None,)))
    assert tuples(gated) == [("buy", False), ("click", True), ("view", True), (None, False)]


def test_item_genres_and_fan_out(ratings, items):
    catalogue = items((1, "A", "x||y"), (2, "B", ""), (3, "C", None))
    assert tuples(catalog.item_genres(catalogue), "item_id", "genre") == [(1, "x"), (1, "y")]
    assert tuples(catalog.item_genres(catalogue, True), "item_id", "genre") == [(1, ""), (1, "x"), (1, "y"), (2, "")]
    fanned = catalog.ratings_with_genres(ratings((7, 1, 3.0, 1), (7, 2, 3.0, 1), (7, 9, 3.0, 1)), catalogue)
    assert tuples(fanned, "user_id", "item_id", "genre") == [(7, 1, "x"), (7, 1, "y")]
