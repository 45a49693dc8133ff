import pytest

from tastegrid.operators import content, taste
from tests.helpers import by, tuples


@pytest.fixture
def world(ratings, items):
    catalogue = items((1, "One (1990)", "a|b"), (2, "Two", "a"), (3, "Three", "c| |"), (4, "Four", None), (5, "Five", "d"))
    rated = ratings((7, 1, 4.0, 10), (7, 2, 2.0, 20), (7, 3, 4.0, 30), (8, 2, 5.0, 5), (8, 2, 5.0, 6), (8, 1, 5.0, 6))
    return rated, catalogue


def test_profile(world):
    found = by(taste.user_genre_profile(*world), "user_id", "genre")
    # raw: a = 6 + .5, b = 4.25, c = 4.25; b and c tie on weight and count, so the name decides.
    assert found[7, "a"]["genre_weight"] == 1.0 and found[7, "a"]["genre_interactions"] == 2
    assert found[7, "a"]["genre_avg_rating"] == 3.0
    assert found[7, "b"]["genre_weight"] == pytest.approx(4.25 / 6.5)
    assert [found[7, g]["favorite_rank"] for g in "abc"] == [1, 2, 3]
    assert (7, " ") not in found and (7, "") not in found
    assert found[8, "a"]["genre_interactions"] == 3


def test_favorite(world):
    assert tuples(taste.favorite_genre(taste.user_taste(*world))) == [(7, "a", 1.0), (8, "a", 1.0)]


def test_anchor_is_best_then_latest_then_lowest(world):
    found = by(taste.anchor_items(*world), "user_id", "genre")
    assert found[7, "a"]["anchor_item_id"] == 1 and found[7, "a"]["anchor_title"] == "One (1990)"
    # User 8 rated both items 5.0 at time 6.
    assert found[8, "a"]["anchor_item_id"] == 1
    assert found[7, "c"]["anchor_rating"] == 4.0


def test_anchor_in_taste_agrees(world):
    merged = taste.user_taste(*world).select("user_id", "tastes").collect()
    lone = by(taste.anchor_items(*world), "user_id", "genre")
    for row in merged:
        for element in row.tastes:
            assert lone[row.user_id, element.genre]["anchor_item_id"] == element.anchor_item_id


def test_drop_seen(world, candidates):
    fresh = content.drop_seen(candidates((7, 1, 1.0), (7, 4, 1.0), (9, 1, 1.0)), world[0])
    assert tuples(fresh) == [(7, 4, 1.0), (9, 1, 1.0)]


def test_content_score(world, candidates):
    offered = candidates((7, 1, 3.0), (7, 1, 4.0), (7, 5, 3.0), (7, 4, 3.0), (7, 99, 3.0), (9, 1, 3.0), (7, 3, 3.0), (7, 3, 3.0))
    rated, catalogue = world
    scored = content.content_score(offered, catalogue, taste.user_taste(rated, catalogue))
    found = by(scored, "user_id", "item_id", "als_score")
    b = 4.25 / 6.5
    assert len(found) == 7
    for score in (3.0, 4.0):
        assert found[7, 1, score]["content_score"] == pytest.approx((1 + b) / 2)
        assert found[7, 1, score]["max_genre_weight"] == 1.0 and found[7, 1, score]["genre_match_count"] == 2
    for key in ((7, 5, 3.0), (7, 4, 3.0), (7, 99, 3.0), (9, 1, 3.0)):
        values = (found[key]["content_score"], found[key]["max_genre_weight"], found[key]["genre_match_count"])
        assert values == (0.0, 0.0, 0)
    # Two equal rows are one whose matches add up.
    assert found[7, 3, 3.0]["genre_match_count"] == 2 and found[7, 3, 3.0]["content_score"] == pytest.approx(b)


def test_partly_matching_genres_count_as_zero(ratings, items, candidates):
    catalogue = items((1, "A", "a"), (2, "B", "a|q|r|s"))
    scored = content.content_score(candidates((1, 2, 1.0)), catalogue, taste.user_taste(ratings((1, 1, 3.0, 1)), catalogue))
    assert tuples(scored, "content_score", "genre_match_count") == [(0.25, 1)]
