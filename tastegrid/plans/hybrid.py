"""From candidates to explained hybrid recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.config import BlendConfig, EvalConfig, PrecomputeConfig
from tastegrid.functions import popularity, ratio_or_zero, release_year, user_bucket
from tastegrid.operators.catalog import item_features
from tastegrid.operators.content import drop_seen, merge_copies, score_beside
from tastegrid.operators.evaluate import eval_users, ranking_metrics
from tastegrid.operators.explain import explain
from tastegrid.operators.popularity import item_popularity
from tastegrid.operators.rerank import rerank, year_extent
from tastegrid.operators.taste import user_taste
from tastegrid.session import placed_by_part, reuse

# The stored layout of a recommendation.
RECOMMENDATION = (
    "user_id item_id als_score content_score max_genre_weight genre_match_count title genres primary_genre "
    "release_year rating_count avg_rating popularity_score popularity_norm als_norm hybrid_score recency_norm "
    "genre_rank rerank_score rank favorite_genre favorite_genre_weight anchor_title explain_because explain_social "
    "explain_genre explain"
).split()


def item_cards(ratings: DataFrame, items: DataFrame, sums: bool = False) -> DataFrame:
    """Features and popularity of every item that is in the catalogue or has ratings.

    Joined once per item, so that candidates meet both in a single join.
    """
    return item_features(items).join(item_popularity(ratings, sums), "item_id", "full_outer")


def _extent(beside: DataFrame, cards: DataFrame, users: DataFrame | None, config: BlendConfig) -> DataFrame:
    # Cards of rated items outside the catalogue have no year.
    if config.recency_extent == "catalog":
        return year_extent(cards)
    if users is None:
        return year_extent(beside)
    return year_extent(beside.select("user_id", "release_year").join(users.select("user_id").distinct(), "user_id", "left_semi"))


# What a ranking needs to know of an item, and what is shown of the ranked rows besides.
RANKED_BY = ("item_id", "genres", "release_year", "popularity_norm")
DETAILS = ("item_id", "title", "genres", "rating_count", "avg_rating", "popularity_score")
# What the shown columns and those of a ranking follow from. Sums of ratings have few digits where their means have many.
SHOWN_FROM = ("item_id", "title", "genres", "rating_count", "rating_sum")


def _reranked(
    candidates: DataFrame,
    ratings: DataFrame,
    items: DataFrame,
    config: BlendConfig,
    top_n: int,
    users: DataFrame | None = None,
    details: bool = False,
    anchors: bool = True,
) -> DataFrame:
    """Unseen candidates scored, boosted and cut to ``top_n`` per user, with ``details`` and their anchor's title if asked for.

    Cards and unseen candidates are kept (``session.reuse``). The latter are placed by item once: seen pairs are dropped,
    copies merged and cards joined there. Then they move once, to their user, and carry what the columns follow from
    instead of the columns: the text of the genres, and for details the title and the rating figures, so that ranked rows
    are looked up nowhere else.
    """
    cards = reuse(item_cards(ratings, items, sums=details))
    most = cards.agg(F.max(F.size("genre_list")).alias("longest"), F.max("popularity_score").alias("highest")).head()
    with placed_by_part(cards.sparkSession):
        fresh = merge_copies(drop_seen(candidates, ratings, by_item=True))
        shown = (*SHOWN_FROM, "release_year") if details else RANKED_BY
        beside = reuse(fresh.join(cards.select(*shown), "item_id", "left"))
    taste = user_taste(ratings, items, anchors, titles=details, users=users)
    moved = beside.drop("release_year") if details else beside
    scored = score_beside(moved, taste, most["longest"] or 0)
    if details:
        mean = F.col("rating_sum") / F.col("rating_count")
        scored = scored.withColumns({"avg_rating": mean, "release_year": release_year()})
        scored = scored.withColumn("popularity_score", popularity()).drop("rating_sum")
        share = ratio_or_zero(F.col("popularity_score"), F.lit(most["highest"]).cast("double"))
        scored = scored.withColumn("popularity_norm", share)
    else:
        scored = scored.drop("genres")
    return rerank(scored, _extent(beside, cards, users, config), top_n, config)


def rerank_candidates(
    candidates: DataFrame,
    ratings: DataFrame,
    items: DataFrame,
    config: BlendConfig = BlendConfig(),
    top_n: int = 10,
    users: DataFrame | None = None,
    anchors: bool = True,
) -> DataFrame:
    """Unseen candidates (of all users, or of those given) scored, boosted and cut to ``top_n`` per user, without item
    details and texts; without ``anchors`` nothing is worked out that only explains them.

    The rows stay narrow while there are many of them: texts of items would only be carried through joins and sorts.
    """
    return _reranked(candidates, ratings, items, config, top_n, users, anchors=anchors)


def with_item_details(recommendations: DataFrame, ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Add title, genres and rating figures."""
    return recommendations.join(item_cards(ratings, items).select(*DETAILS), "item_id", "left")


def hybrid_from_candidates(
    candidates: DataFrame, ratings: DataFrame, items: DataFrame, config: BlendConfig = BlendConfig(), top_n: int = 10
) -> DataFrame:
    """Explained ``top_n`` recommendations per user."""
    return explain(_reranked(candidates, ratings, items, config, top_n, details=True)).select(*RECOMMENDATION)


def hybrid_precomputed(
    candidates: DataFrame,
    ratings: DataFrame,
    items: DataFrame,
    config: BlendConfig = BlendConfig(),
    store: PrecomputeConfig = PrecomputeConfig(),
) -> DataFrame:
    """Recommendations ready to be stored for serving."""
    best = hybrid_from_candidates(candidates, ratings, items, config, store.top_n)
    return best.withColumns(
        {
            "route": F.lit("hybrid"),
            "score": F.col("rerank_score"),
            "user_bucket": user_bucket(buckets=store.buckets),
        }
    )


def hybrid_ranking_eval(
    candidates: DataFrame,
    train: DataFrame,
    test: DataFrame,
    items: DataFrame,
    config: BlendConfig = BlendConfig(),
    evaluation: EvalConfig = EvalConfig(),
) -> DataFrame:
    """Ranking metrics of hybrid recommendations built from ``train`` for the users of ``test``."""
    best = rerank_candidates(candidates, train, items, config, evaluation.k, eval_users(test), anchors=False)
    return ranking_metrics(best.select("user_id", "item_id", "rank"), test, evaluation)
