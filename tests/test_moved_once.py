"""Candidates move once to their item and once to their user; nothing is looked up for ranked rows after that."""

import pytest
from pyspark.sql import functions as F

from tastegrid import session
from tastegrid.operators import content, explain, popularity, taste
from tastegrid.plans import hybrid
from tests.helpers import by, plan, tuples
from workload.views import Views


@pytest.fixture
def kept_in(tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"{tmp_path}/shared")


@pytest.fixture
def shuffled(spark):
    """Joins are shuffled, as those of large tables are."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(name, None) for name in names]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name, value in zip(names, before):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_ranked_rows_are_not_shuffled(spark, small_dir, kept_in, shuffled):
    view = Views(spark, small_dir)
    text = plan(hybrid.hybrid_from_candidates(view.candidates(), view.ratings(), view.items(), top_n=5))
    above = text[: text.index("Window [row_number()")]
    assert "Join" not in above and "Exchange" not in above


def test_unseen_candidates_lie_by_item(spark, small_dir, shuffled):
    view = Views(spark, small_dir)
    cards = hybrid.item_cards(view.ratings(), view.items())
    with session.placed_by_part(spark):
        fresh = content.merge_copies(content.drop_seen(view.candidates(by_item=True), view.ratings(), by_item=True))
        text = plan(fresh.join(cards, "item_id", "left"))
    # Only the cleaning of the view's ratings shuffles by user.
    assert text.count("REPARTITION_BY_COL") == 2
    assert not [line for line in text.splitlines() if "ENSURE_REQUIREMENTS" in line and "hashpartitioning(user_id#" in line and "ts#" not in line]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert tuples(fresh.drop("copies")) == tuples(content.drop_seen(view.candidates(), view.ratings()))


def test_the_same_candidates_wherever_they_lie(spark, small_dir):
    view = Views(spark, small_dir)
    assert tuples(view.candidates(by_item=True)) == tuples(view.candidates())
    assert view.candidates().count() == view.candidates().select("user_id", "item_id").distinct().count()


@pytest.fixture
def world(ratings, items):
    catalogue = items((1, "One (1990)", "a|b"), (2, "Two", "a"), (3, "Three (2001)", ""), (4, "Four (1995)", "b"), (5, "Five (1999)", "c"))
    rated = ratings((7, 1, 4.0, 10), (7, 2, 4.5, 20), (8, 2, 0.7, 5), (9, 2, 1.1, 5), (9, 77, 3.3, 5))
    return rated, catalogue


def test_details_are_those_of_the_cards(world, candidates):
    rated, catalogue = world
    pairs = [(u, i) for u in (7, 8, 9, 10) for i in (1, 2, 3, 4, 5, 77, 99)]
    offered = candidates(*[(u, i, float(u + i) / 40) for u, i in [*pairs, (7, 4)]])
    got = by(hybrid.hybrid_from_candidates(offered, rated, catalogue), "user_id", "item_id")
    seen = {(r.user_id, r.item_id) for r in rated.collect()}
    assert got.keys() == set(pairs) - seen
    cards = by(hybrid.item_cards(rated, catalogue), "item_id")
    for (_, item), row in got.items():
        card = cards.get(item, dict.fromkeys((*hybrid.DETAILS, "release_year", "primary_genre")))
        for name in (*hybrid.DETAILS[1:], "release_year", "primary_genre"):
            assert row[name] == card[name], (item, name)
        assert row["popularity_norm"] == (card.get("popularity_norm") or 0.0)
    assert got[7, 4]["genre_match_count"] == 2
    best = explain.with_anchor_title(hybrid.rerank_candidates(offered, rated, catalogue), catalogue)
    assert tuples(best, "user_id", "item_id", "anchor_title", "rank") == sorted(
        ((u, i, r["anchor_title"], r["rank"]) for (u, i), r in got.items()), key=lambda row: [(v is None, str(v)) for v in row]
    )
    assert got[7, 4]["anchor_title"] == "One (1990)" and got[7, 5]["anchor_title"] is None


def test_without_ratings_nothing_is_popular(world, candidates):
    rated, catalogue = world
    rows = hybrid.hybrid_from_candidates(candidates((7, 1, 1.0), (7, 99, 2.0)), rated.limit(0), catalogue).collect()
    assert [(r.item_id, r.popularity_norm, r.rating_count) for r in rows] == [(99, 0.0, None), (1, 0.0, None)]


def test_taste_of_given_users(rows, world):
    asked = rows("user_id int", (7,), (7,), (10,), (None,))
    found = {r.user_id: r for r in taste.user_taste(*world, users=asked).collect()}
    assert {u: r.asked for u, r in found.items()} == {7: True, 8: False, 9: False, 10: True, None: True}
    assert found[10].tastes == []
    plain = {r.user_id: r.tastes for r in taste.user_taste(*world).collect()}
    assert {u: found[u].tastes for u in plain} == plain


def test_sums_give_the_means(world):
    stats = popularity.item_stats(world[0], sums=True)
    assert stats.filter(F.col("avg_rating") != F.col("rating_sum") / F.col("rating_count")).count() == 0
    assert "rating_sum" not in popularity.item_popularity(world[0]).columns
