"""The re-ranking computes its inputs once and looks weights up in compiled code."""

import pytest

from tastegrid import session
from tastegrid.operators import content, taste
from tastegrid.plans import hybrid
from tests.helpers import by, plan, tuples
from workload.views import Views


@pytest.fixture
def kept_in(tmp_path, monkeypatch):
    """A shared folder, so that kept tables are files."""
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"{tmp_path}/shared")


@pytest.fixture
def world(ratings, items):
    long = "|".join(f"g{n}" for n in range(20))
    catalogue = items((1, "One (1990)", "a|b"), (2, "Two (1995)", "a"), (3, "Three", long), (4, "Four", "x|a|b|c|a|q|b|g1"), (5, "Five", ""))
    rated = ratings((7, 1, 4.0, 10), (7, 2, 2.0, 20), (7, 3, 4.5, 30), (8, 2, 5.0, 5))
    return rated, catalogue


def weights(world, offered, longest):
    rated, catalogue = world
    features = hybrid.item_features(catalogue).select("item_id", "genre_list", "primary_genre")
    scored = content.score_content(offered, features, taste.user_taste(rated, catalogue), longest)
    return scored.select("user_id", "item_id", "content_score", "max_genre_weight", "genre_match_count", "anchor_item_id")


@pytest.mark.parametrize("longest", [None, 20, 16])
def test_weights_of_lists_of_any_length(world, candidates, longest):
    found = by(taste.user_genre_profile(*world), "user_id", "genre")
    lists = {r.item_id: (r.genres or "").split("|") for r in world[1].collect()}
    offered = [(user, item) for user in (7, 8, 9) for item in (1, 2, 3, 4, 5, 99) if longest != 16 or item != 3]
    got = by(weights(world, candidates(*[(*pair, 1.0) for pair in offered]), longest), "user_id", "item_id")
    for user, item in offered:
        genres = [g for g in lists.get(item, []) if g.strip()]
        have = [found[user, g]["genre_weight"] for g in genres if (user, g) in found]
        row = got[user, item]
        assert row["content_score"] == pytest.approx(sum(have) / len(genres) if genres else 0.0)
        assert row["max_genre_weight"] == max(have, default=0.0) and row["genre_match_count"] == len(have)


def test_known_lists_need_no_array_functions(world, candidates):
    def scoring(longest):
        text = plan(weights(world, candidates((7, 1, 1.0)), longest))
        return text[: text.index("Join")]

    assert "lambda" in scoring(None) and "lambda" not in scoring(8)


def test_seen_candidates_are_dropped_once(spark, small_dir, kept_in):
    view = Views(spark, small_dir)
    best = hybrid.rerank_candidates(view.candidates(), view.ratings(), view.items(), top_n=5)
    text = plan(best, run=True)
    assert "LeftAnti" not in text


def test_distinct_pairs_are_hashed(spark, small_dir):
    view = Views(spark, small_dir)
    assert "ShuffledHashJoin" in plan(content.drop_seen(view.candidates(), view.ratings()))


def test_only_given_users_are_ranked(spark, small_dir):
    view = Views(spark, small_dir)
    users = view.ratings().filter("user_id % 3 = 0").select("user_id")
    wanted = view.candidates().join(users.distinct(), "user_id", "left_semi")
    expected = hybrid.rerank_candidates(wanted, view.ratings(), view.items(), top_n=5)
    got = hybrid.rerank_candidates(view.candidates(), view.ratings(), view.items(), top_n=5, users=users)
    assert tuples(got) == tuples(expected) and got.count() > 0


def test_kept_ratings_are_the_ratings(spark, small_dir, kept_in):
    view = Views(spark, small_dir)
    plain, kept = tuples(view.ratings()), view.keep_ratings().ratings()
    assert tuples(kept) == plain and "Join" not in plan(kept)
