"""A part of the registered queries against their SQL on the smallest tables, and the contract itself."""

import pytest

import __spark_entry__ as contract
from workload.check import compare
from workload.views import Views

CHECKED = [
    "clean_ratings",
    "clean_stats",
    "event_gate",
    "merge_feedback",
    "item_features",
    "item_popularity",
    "fallback_all",
    "user_genre_profile",
    "anchor_items",
    "content_score",
    "hybrid_from_candidates",
    "ranking_metrics",
    "serve_batch",
    "route_profiles",
    "latest_profile_rating",
    "history_last_n",
    "stream_feedback_sink",
    "stored_history",
    "ingest_feedback",
    "profile_rating_store",
    "serve_distinct",
    "published_fallback",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, duck, small_dir, name):
    assert compare(spark, duck, small_dir, name) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns[:2] == ["user_id", "item_id"]


def test_counts_of_the_views(spark, small_dir):
    view = Views(spark, small_dir)
    assert view.ratings_raw().count() == 6000 and view.ratings().count() == 4618
    assert view.ratings().selectExpr("sum(rating)").head()[0] == 12996.0
    assert view.items().count() == 200
    users = view.candidates().select("user_id").distinct().count()
    assert users == view.ratings().select("user_id").distinct().count() == 150
