import math

import pytest

from tastegrid import FallbackConfig
from tastegrid.operators import fallback, popularity
from tests.helpers import by, tuples


@pytest.fixture
def rated(ratings):
    return ratings(
        *[(u, 1, 4.0, 1) for u in range(3)],
        *[(u, 2, 4.0, 1) for u in range(3)],
        *[(u, 3, 5.0, 1) for u in range(2)],
        (9, 4, 1.0, 1),
    )


def test_item_popularity(rated):
    found = by(popularity.item_popularity(rated), "item_id")
    top = 4.0 * math.log(4)
    assert found[1]["rating_count"] == 3 and found[1]["popularity_score"] == pytest.approx(top)
    assert found[1]["popularity_norm"] == 1.0
    assert found[4]["popularity_norm"] == pytest.approx(math.log(2) / top)
    assert popularity.item_popularity(rated.filter("false")).count() == 0


def test_min_count(rated):
    assert [r[0] for r in tuples(popularity.item_stats(rated, 3), "item_id")] == [1, 2]


def test_global_list_breaks_ties_by_item(rated, items):
    catalogue = items((1, "A", "x"), (2, "B", "x|y"), (3, "C", "y"))
    best = fallback.fallback_global(rated, catalogue, FallbackConfig(top_n=2, min_rating_count=2))
    assert tuples(best, "rank", "item_id", "genre", "fallback_type") == [(1, 1, None, "global"), (2, 2, None, "global")]


def test_genre_lists_match_a_fan_out(rated, items):
    catalogue = items((1, "A", "x|x"), (2, "B", "x||y"), (3, "C", "y"), (4, "D", "z"), (5, "E", "z"))
    config = FallbackConfig(top_n=10, min_rating_count=2)
    lists = fallback.fallback_by_genre(rated, catalogue, config)
    # Item 1 lists x twice, so its ratings count twice there; the blank genre of item 2 is a genre of its own.
    assert tuples(lists, "genre", "rank", "item_id", "rating_count") == [
        ("", 1, 2, 3),
        ("x", 1, 1, 6),
        ("x", 2, 2, 3),
        ("y", 1, 2, 3),
        ("y", 2, 3, 2),
    ]
    whole = fallback.fallback_all(rated, catalogue, config)
    assert whole.count() == 5 + 3
