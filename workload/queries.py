"""The registered queries: every operator over whole tables of one data folder.

Scores are rounded to 9 decimals in the output, so that the last bits of a sum, which depend on the order of addition,
do not decide a comparison with another engine.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid import (
    BlendConfig,
    EvalConfig,
    FallbackConfig,
    PrecomputeConfig,
    ServeConfig,
    apply_session_settings,
)
from tastegrid.functions import (
    als_norm,
    genre_array,
    ideal_dcg,
    request_key,
    title_without_year,
)
from tastegrid.operators import als as als_ops
from tastegrid.operators import catalog, cleaning, content, evaluate, explain, fallback, gates, popularity
from tastegrid.operators import profiles as profile_ops
from tastegrid.operators import rerank as rerank_ops
from tastegrid.operators import serving, split, summaries, taste
from tastegrid.plans import hybrid as hybrid_plan
from tastegrid.plans.etl import run_etl
from tastegrid.plans.training import StorePaths, TrainingConfig, als_grid, retrain_job
from tastegrid.schemas import TRIALS
from tastegrid.session import release, reuse, scratch_path
from tastegrid.sources import history as stored_history
from tastegrid.sources import raw, releases, tables
from tastegrid.streaming import feeds, ingest, upserts
from workload.views import Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}



def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register ``build`` under its name without the leading ``q_``."""

    @functools.wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Views(apply_session_settings(spark), sf_dir))

    QUERIES[build.__name__.removeprefix("q_")] = run
    return build


def rounded(df: DataFrame) -> DataFrame:
    """All DOUBLE columns at 9 decimals."""
    return df.select(*[F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("long") for name in names})


# Reading and writing -------------------------------------------------------------------------------------------------


def _as_dat(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """Write rows as ``::``-separated lines into a folder that reads as ``.dat``."""
    line = F.concat_ws("::", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.option("encoding", encoding).text(path)
    return path


@query
def q_read_ratings(v: Views) -> DataFrame:
    rows = v.ratings_raw().select("user_id", "item_id", "rating", "ts")
    return raw.read_ratings(v.spark, _as_dat(rows, scratch_path(v.spark, "ratings.dat")))


@query
def q_read_items(v: Views) -> DataFrame:
    return raw.read_items(v.spark, _as_dat(v.items_raw(), scratch_path(v.spark, "items.dat")))


@query
def q_read_feedback(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "feedback")
    v.feedback().write.option("header", True).csv(path)
    return raw.read_feedback(v.spark, path)


@query
def q_header_auto(v: Views) -> DataFrame:
    """The same feedback once with and once without a header line; both read back in full."""
    headed, plain = scratch_path(v.spark, "headed"), scratch_path(v.spark, "plain")
    v.feedback().write.option("header", True).csv(headed)
    v.feedback().write.csv(plain)
    read = [raw.read_ratings(v.spark, path) for path in (headed, plain)]
    return read[0].withColumn("header", F.lit("yes")).unionByName(read[1].withColumn("header", F.lit("no")))


@query
def q_write_silver_ratings(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "silver_ratings")
    tables.write_silver_ratings(v.ratings(), path)
    return tables.read_silver_ratings(v.spark, path)


@query
def q_read_silver_ratings(v: Views) -> DataFrame:
    """Stored ratings of the users who asked for something, read by bucket and user."""
    path = scratch_path(v.spark, "silver_ratings")
    tables.write_silver_ratings(v.ratings(), path)
    return tables.in_buckets_of(tables.read_silver_ratings(v.spark, path), v.requests()).select(
        "user_id", "item_id", "rating", "ts", "user_bucket"
    )


@query
def q_write_silver_items(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "silver_items")
    tables.write_silver_items(v.items(), path)
    return tables.read_silver_items(v.spark, path)


@query
def q_read_silver_items(v: Views) -> DataFrame:
    """Raw text to silver tables in one job, then the stored items."""
    spark = v.spark
    raw_ratings = _as_dat(v.ratings_raw().select("user_id", "item_id", "rating", "ts"), scratch_path(spark, "r.dat"))
    raw_items = _as_dat(v.items_raw(), scratch_path(spark, "i.dat"))
    silver_items = scratch_path(spark, "silver_items")
    run_etl(spark, raw_ratings, raw_items, scratch_path(spark, "silver_ratings"), silver_items)
    return tables.read_silver_items(spark, silver_items)


@query
def q_write_gold_fallback(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "fallback")
    tables.write_gold_fallback(_fallback(v), path)
    return rounded(tables.read_gold_fallback(v.spark, path))


@query
def q_read_gold_fallback(v: Views) -> DataFrame:
    """The table is missing at first, so reading rebuilds it."""
    path = scratch_path(v.spark, "fallback")
    return rounded(tables.read_gold_fallback(v.spark, path, rebuild=lambda: _fallback(v)))


@query
def q_write_gold_precomputed(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "precomputed")
    tables.write_gold_precomputed(_precomputed(v), path)
    return _shown(tables.read_gold_precomputed(v.spark, path))


@query
def q_read_gold_precomputed(v: Views) -> DataFrame:
    """Stored recommendations of the users who asked for something, read by bucket and user."""
    path = scratch_path(v.spark, "precomputed")
    tables.write_gold_precomputed(_precomputed(v), path)
    mine = tables.in_buckets_of(tables.read_gold_precomputed(v.spark, path), v.requests())
    return rounded(mine.select("user_id", "item_id", "rank", "score", "user_bucket"))


# Cleaning and gates --------------------------------------------------------------------------------------------------


@query
def q_clean_ratings(v: Views) -> DataFrame:
    return v.bucketed_ratings()


@query
def q_clean_items(v: Views) -> DataFrame:
    return v.items()


@query
def q_clean_stats(v: Views) -> DataFrame:
    return cleaning.clean_stats(v.ratings_raw(), v.items_raw())


@query
def q_user_bucket(v: Views) -> DataFrame:
    return cleaning.with_user_bucket(v.ratings().select("user_id").distinct())


@query
def q_merge_feedback(v: Views) -> DataFrame:
    return v.merged()


@query
def q_rating_gate(v: Views) -> DataFrame:
    return gates.rating_gate(v.feedback())


@query
def q_event_gate(v: Views) -> DataFrame:
    return gates.event_gate(v.events()).select("event_id", "timestamp", "event_type", "user_id", "item_id", "accepted")


@query
def q_rating_to_event(v: Views) -> DataFrame:
    raised = gates.rating_to_event(v.feedback())
    return raised.select(
        "timestamp", "event_type", "user_id", "item_id", F.col("metadata")["rating"].cast("double").alias("rating")
    )


# Items ---------------------------------------------------------------------------------------------------------------


@query
def q_genre_array(v: Views) -> DataFrame:
    lists = v.items().select("item_id", genre_array().alias("kept"), genre_array(keep_blank=True).alias("every"))
    return lists.select(
        "item_id",
        F.array_join("kept", "+").alias("genres_kept"),
        F.size("kept").cast("long").alias("kept_count"),
        F.array_join("every", "+").alias("genres_all"),
        F.size("every").cast("long").alias("all_count"),
    )


@query
def q_explode_genres(v: Views) -> DataFrame:
    return catalog.item_genres(v.items()).select("item_id", "genre")


@query
def q_explode_genres_blank(v: Views) -> DataFrame:
    return catalog.item_genres(v.items(), keep_blank=True).select("item_id", "genre")


@query
def q_item_features(v: Views) -> DataFrame:
    return catalog.item_features(v.items()).drop("genre_list")


@query
def q_title_without_year(v: Views) -> DataFrame:
    return v.items().select("item_id", title_without_year().alias("short_title"))


@query
def q_genre_contains(v: Views) -> DataFrame:
    return catalog.genre_contains(v.items(), "Red")


@query
def q_genre_equals(v: Views) -> DataFrame:
    return rounded(longs(catalog.genre_equals(fallback.fallback_by_genre(v.ratings(), v.items()), "Economy"), "rank"))


@query
def q_ratings_x_genres(v: Views) -> DataFrame:
    return catalog.ratings_with_genres(v.ratings(), v.items())


# Popularity and fallback ---------------------------------------------------------------------------------------------


def _fallback(v: Views) -> DataFrame:
    # As many rows as the largest request may ask for.
    return fallback.fallback_all(v.ratings(), v.items(), FallbackConfig(top_n=20))


@query
def q_item_popularity(v: Views) -> DataFrame:
    return rounded(popularity.item_popularity(v.ratings()))


@query
def q_item_stats_min_count(v: Views) -> DataFrame:
    return rounded(popularity.item_stats(v.ratings(), FallbackConfig().min_rating_count))


@query
def q_genre_item_stats(v: Views) -> DataFrame:
    return rounded(fallback.genre_item_stats(v.ratings(), v.items(), FallbackConfig().min_rating_count))


@query
def q_fallback_global(v: Views) -> DataFrame:
    return rounded(longs(fallback.fallback_global(v.ratings(), v.items()), "rank"))


@query
def q_fallback_by_genre(v: Views) -> DataFrame:
    return rounded(longs(fallback.fallback_by_genre(v.ratings(), v.items()), "rank"))


@query
def q_fallback_all(v: Views) -> DataFrame:
    return rounded(longs(fallback.fallback_all(v.ratings(), v.items()), "rank"))


@query
def q_top_trending(v: Views) -> DataFrame:
    return rounded(longs(serving.top_trending(_fallback(v), 10), "rank"))


@query
def q_top_by_genre(v: Views) -> DataFrame:
    wanted = v.requests().filter(F.col("genre").isNotNull())
    return rounded(longs(serving.top_by_genre(_fallback(v), wanted, 10), "rank"))


# Taste and content ---------------------------------------------------------------------------------------------------


@query
def q_user_genre_profile(v: Views) -> DataFrame:
    return rounded(longs(taste.user_genre_profile(v.ratings(), v.items()), "favorite_rank"))


@query
def q_favorite_genre(v: Views) -> DataFrame:
    return rounded(taste.favorite_genre(taste.user_taste(v.ratings(), v.items(), anchors=False)))


@query
def q_anchor_items(v: Views) -> DataFrame:
    return taste.anchor_items(v.ratings(), v.items())


@query
def q_seen_pairs(v: Views) -> DataFrame:
    return content.seen_pairs(v.ratings())


@query
def q_drop_seen(v: Views) -> DataFrame:
    return content.drop_seen(v.candidates(), v.ratings())


@query
def q_content_score(v: Views) -> DataFrame:
    scored = content.content_score(v.candidates(), v.items(), taste.user_taste(v.ratings(), v.items(), anchors=False))
    return rounded(longs(scored, "genre_match_count"))


# Re-ranking ----------------------------------------------------------------------------------------------------------


@query
def q_als_norm(v: Views) -> DataFrame:
    return rounded(v.candidates().withColumn("als_norm", als_norm()))


@query
def q_hybrid_score(v: Views) -> DataFrame:
    scored = content.content_score(v.candidates(), v.items(), taste.user_taste(v.ratings(), v.items(), anchors=False))
    blended = rerank_ops.hybrid_score(scored)
    return rounded(blended.select("user_id", "item_id", "als_score", "content_score", "als_norm", "hybrid_score"))


@query
def q_recency_norm(v: Views) -> DataFrame:
    years = catalog.item_features(v.items()).select("item_id", "title", "release_year")
    return rounded(rerank_ops.recency_norm(years, rerank_ops.year_extent(years)))


def _best(v: Views, top_n: int = 10, anchors: bool = False) -> DataFrame:
    v.keep_ratings()
    return hybrid_plan.rerank_candidates(v.candidates(by_item=True), v.ratings(), v.items(), BlendConfig(), top_n, anchors=anchors)


@query
def q_hybrid_rerank(v: Views) -> DataFrame:
    columns = (
        "user_id item_id primary_genre release_year als_norm hybrid_score popularity_norm recency_norm "
        "genre_rank rerank_score rank"
    ).split()
    return rounded(longs(_best(v).select(*columns), "genre_rank", "rank"))


@query
def q_final_rank(v: Views) -> DataFrame:
    return longs(_best(v).select("user_id", "item_id", "rank"), "rank")


def _shown(recommendations: DataFrame) -> DataFrame:
    return rounded(longs(recommendations, "genre_match_count", "genre_rank", "rank"))


def _hybrid(v: Views) -> DataFrame:
    v.keep_ratings()
    return hybrid_plan.hybrid_from_candidates(v.candidates(by_item=True), v.ratings(), v.items())


@query
def q_hybrid_from_candidates(v: Views) -> DataFrame:
    return _shown(_hybrid(v))


@query
def q_explain(v: Views) -> DataFrame:
    best = hybrid_plan.with_item_details(_best(v, anchors=True), v.ratings(), v.items())
    texts = explain.explain(explain.with_anchor_title(best, v.items()))
    return texts.select("user_id", "item_id", "anchor_title", "explain_because", "explain_social", "explain_genre", "explain")


def _precomputed(v: Views) -> DataFrame:
    v.keep_ratings()
    return hybrid_plan.hybrid_precomputed(v.candidates(by_item=True), v.ratings(), v.items(), BlendConfig(), PrecomputeConfig())


@query
def q_hybrid_precomputed(v: Views) -> DataFrame:
    return _shown(_precomputed(v))


# Evaluation ----------------------------------------------------------------------------------------------------------


@query
def q_train_test_split(v: Views) -> DataFrame:
    return split.with_split(v.ratings())


@query
def q_eval_users(v: Views) -> DataFrame:
    return evaluate.eval_users(v.train_test()[1])


@query
def q_relevant_items(v: Views) -> DataFrame:
    return evaluate.relevant_items(v.train_test()[1])


def _eval_recommendations(v: Views) -> DataFrame:
    train, test = v.keep_ratings().train_test()
    users = evaluate.eval_users(test)
    best = hybrid_plan.rerank_candidates(v.candidates(by_item=True), train, v.items(), BlendConfig(), EvalConfig().k, users, anchors=False)
    return best.select("user_id", "item_id", "rank")


@query
def q_recommended_list(v: Views) -> DataFrame:
    lists = evaluate.recommended_list(_eval_recommendations(v), EvalConfig().k)
    return lists.select("user_id", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"))


@query
def q_top_k_slice(v: Views) -> DataFrame:
    placed = evaluate.judged_positions(_eval_recommendations(v), v.train_test()[1], EvalConfig(k=5))
    return longs(placed.select("user_id", "item_id", "rank", "position"), "rank", "position")


@query
def q_hits_per_user(v: Views) -> DataFrame:
    gains = evaluate.user_gains(_eval_recommendations(v), v.train_test()[1])
    return longs(gains.select("user_id", "hit_count"), "hit_count")


@query
def q_dcg_per_user(v: Views) -> DataFrame:
    return rounded(evaluate.user_gains(_eval_recommendations(v), v.train_test()[1]).select("user_id", "dcg"))


@query
def q_idcg(v: Views) -> DataFrame:
    counts = evaluate.relevant_items(v.train_test()[1]).groupBy("user_id").agg(F.count("*").alias("relevant_count"))
    return rounded(counts.withColumn("idcg", ideal_dcg(F.col("relevant_count"), EvalConfig().k)))


@query
def q_ranking_metrics(v: Views) -> DataFrame:
    return rounded(longs(evaluate.ranking_metrics(_eval_recommendations(v), v.train_test()[1]), "k"))


@query
def q_hybrid_ranking_eval(v: Views) -> DataFrame:
    train, test = v.keep_ratings().train_test()
    return rounded(longs(hybrid_plan.hybrid_ranking_eval(v.candidates(by_item=True), train, test, v.items()), "k"))


@query
def q_rmse(v: Views) -> DataFrame:
    """Error of predicting each test rating by the item's mean in the training ratings."""
    train, test = v.train_test()
    means = popularity.item_stats(train).select("item_id", F.col("avg_rating").alias("prediction"))
    return rounded(evaluate.rmse(test.join(means, "item_id")))


def _trials(v: Views) -> DataFrame:
    """Errors of constant predictions, by line number and return flag, in the trial layout."""
    lines = v.table("lineitem").select("l_linenumber", "l_returnflag", "l_quantity")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    miss = F.col("l_quantity") - 25
    grouped = lines.groupBy("l_linenumber", flag.alias("flag")).agg(F.round(F.sqrt(F.avg(miss * miss)), 9).alias("rmse"))
    return grouped.select(
        F.lit("run-1").alias("run_id"),
        (F.col("l_linenumber") * 10 + F.col("flag")).alias("trial_no"),
        (F.col("l_linenumber") * 4).alias("rank"),
        (F.col("flag").cast("double") / 4).alias("reg_param"),
        F.lit(10).alias("max_iter"),
        "rmse",
    )


@query
def q_best_trial(v: Views) -> DataFrame:
    return summaries.best_trial(_trials(v))


@query
def q_append_trials(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "trials")
    tables.append_trials(_trials(v), path)
    return v.spark.read.parquet(path)


def _metric_rows(v: Views) -> DataFrame:
    """Shares of well-rated lines per year, in the metrics layout."""
    share = F.avg(F.when(F.col("rating") >= 4.0, 1.0).otherwise(0.0))
    return v.ratings().groupBy(F.timestamp_seconds("ts").cast("timestamp").alias("timestamp_utc")).agg(
        F.lit("hybrid_rerank").alias("algorithm"),
        share.alias("precision_at_k"),
        F.count("*").alias("evaluated_users"),
    )


@query
def q_latest_metrics(v: Views) -> DataFrame:
    last = summaries.latest_metrics(_metric_rows(v))
    return rounded(last.withColumn("timestamp_utc", F.unix_seconds("timestamp_utc")))


@query
def q_append_ranking_metrics(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "metrics")
    metrics = evaluate.ranking_metrics(_eval_recommendations(v), v.train_test()[1])
    tables.append_ranking_metrics(metrics, path)
    return rounded(longs(v.spark.read.parquet(path).drop("timestamp_utc"), "k"))


# Serving -------------------------------------------------------------------------------------------------------------


@query
def q_request_key(v: Views) -> DataFrame:
    asked = serving.prepare_requests(v.requests())
    return asked.withColumn("request_key", request_key("user_id", "top_n", "genre"))


@query
def q_distinct_requests(v: Views) -> DataFrame:
    """Profile requests of a whole order table collapse to their distinct questions."""
    return serving.distinct_requests(serving.prepare_requests(_profile_requests(v)))


@query
def q_user_has_history(v: Views) -> DataFrame:
    return serving.user_has_history(v.requests(), v.merged()).select("request_id", "user_id", "has_history")


@query
def q_normalize_recs(v: Views) -> DataFrame:
    return rounded(longs(serving.normalize_recs(_precomputed(v), "user_id"), "rank"))


def _flat(answers: DataFrame, section: str, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    rows = answers.select(*keys, F.posexplode(section).alias("pos", "rec"))
    return rounded(longs(rows.select(*keys, "pos", "rec.*"), "pos"))


@query
def q_serve_hybrid(v: Views) -> DataFrame:
    served = serving.serve_hybrid(serving.prepare_requests(v.requests()), _precomputed(v))
    return longs(_flat(served, "hybrid"), "rank")


@query
def q_route_requests(v: Views) -> DataFrame:
    routed = serving.route_requests(v.requests(), v.merged(), _precomputed(v))
    return routed.select("request_id", "user_id", "top_n", "genre", "has_history", "route")


def _answers(v: Views, requests: DataFrame | None = None) -> DataFrame:
    asked = v.requests() if requests is None else requests
    return serving.serve_batch(asked, v.merged(), _precomputed(v), _fallback(v))


@query
def q_serve_batch(v: Views) -> DataFrame:
    """The nested responses, one row per request, flattened to one row per list entry."""
    answers = _answers(v)
    plain = F.transform(
        "recommendations", lambda r: F.struct(r["item_id"], r["title"], r["score"], r["explain"])
    )
    trending = F.transform("top_trending", lambda r: F.struct(r["item_id"], r["title"], r["score"], r["explain"]))
    by_genre = F.transform("top_by_genre", lambda r: F.struct(r["item_id"], r["title"], r["score"], r["explain"]))
    sections = F.array(
        F.struct(F.lit("recommendations").alias("section"), plain.alias("rows")),
        F.struct(F.lit("top_trending").alias("section"), trending.alias("rows")),
        F.struct(F.lit("top_by_genre").alias("section"), by_genre.alias("rows")),
    )
    lists = answers.select("request_id", "route", "selected_genre", F.inline(sections))
    rows = lists.select("request_id", "route", "selected_genre", "section", F.posexplode("rows").alias("pos", "rec"))
    flat = rows.select("request_id", "route", "selected_genre", "section", "pos", "rec.*")
    return rounded(longs(flat, "pos"))


@query
def q_serve_fallback(v: Views) -> DataFrame:
    """Responses of the requests that end in the fallback."""
    return _flat(_answers(v).filter(F.col("route") == "fallback"), "recommendations").drop("rank")


@query
def q_serve_distinct(v: Views) -> DataFrame:
    """All profile requests, many of them equal, with each distinct one answered once."""
    answers = serving.serve_distinct(_profile_requests(v), v.merged(), _precomputed(v), _fallback(v), copy_requests=5)
    return _flat(answers, "because_you_watched")


@query
def q_because_you_watched(v: Views) -> DataFrame:
    return _flat(_answers(v), "because_you_watched")


@query
def q_score_rows(v: Views) -> DataFrame:
    return _flat(_answers(v), "scores")


@query
def q_selected_genre(v: Views) -> DataFrame:
    return _answers(v).select("request_id", "route", "selected_genre")


# Profiles ------------------------------------------------------------------------------------------------------------


@query
def q_profile_defaults(v: Views) -> DataFrame:
    return profile_ops.profile_defaults(v.profiles())


@query
def q_active_profiles(v: Views) -> DataFrame:
    return profile_ops.active_profiles(v.profiles())


def _profile_requests(v: Views) -> DataFrame:
    return profile_ops.route_profiles(v.profile_requests(), profile_ops.profile_defaults(v.profiles()))


@query
def q_route_profiles(v: Views) -> DataFrame:
    return longs(_profile_requests(v), "top_n")


@query
def q_latest_profile_rating(v: Views) -> DataFrame:
    return profile_ops.latest_profile_rating(v.profile_writes())


@query
def q_ensure_item_stub(v: Views) -> DataFrame:
    return profile_ops.ensure_item_stub(v.items(), v.candidates())


@query
def q_recommendation_history(v: Views) -> DataFrame:
    """History rows written for answered profile requests."""
    asked = _profile_requests(v)
    path = scratch_path(v.spark, "history")
    stored_history.append_history(profile_ops.recommendation_history(_answers(v, asked), asked), path, batch=0)
    return longs(stored_history.read_history(v.spark, path).drop("history_id", "created_at"), "top_n")


@query
def q_stored_history(v: Views) -> DataFrame:
    """Answers to all profile requests stored in two batches, each delivered twice; every profile's latest five."""
    asked = reuse(_profile_requests(v))
    path = scratch_path(v.spark, "history")
    rows = reuse(profile_ops.recommendation_history(_answers(v, asked), asked))
    for batch in (0, 0, 1, 1):
        stored_history.append_history(rows.filter(F.col("request_id") % 2 == batch), path, batch)
    return longs(profile_ops.history_last_n(stored_history.read_history(v.spark, path).drop("created_at"), 5), "place", "top_n")


@query
def q_history_last_n(v: Views) -> DataFrame:
    return longs(profile_ops.history_last_n(v.history(), 5), "place", "top_n")


# Streams -------------------------------------------------------------------------------------------------------------


def _drained(*started) -> None:
    for running in started:
        running.awaitTermination()


@query
def q_stream_event_sink(v: Views) -> DataFrame:
    """All events as JSON files through the stream; accepted and rejected rows as stored."""
    spark, root = v.spark, scratch_path(v.spark, "event_stream")
    v.events().select(*feeds.EVENT_COLUMNS).write.json(f"{root}/in")
    _drained(
        *feeds.stream_event_sink(
            feeds.event_source(spark, f"{root}/in"), f"{root}/out", f"{root}/rejected", f"{root}/state", once=True
        )
    )
    good = spark.read.parquet(f"{root}/out").withColumn("accepted", F.lit(True))
    both = good.unionByName(spark.read.parquet(f"{root}/rejected").withColumn("accepted", F.lit(False)))
    return both.select(
        "timestamp",
        "event_type",
        "user_id",
        "item_id",
        F.col("metadata")["k"].alias("k"),
        F.col("dt").cast("string").alias("dt"),
        "accepted",
    )


@query
def q_stream_feedback_sink(v: Views) -> DataFrame:
    """All feedback as CSV files through the stream in two deliveries; accepted ratings once each, and rejected rows."""
    spark, root = v.spark, scratch_path(v.spark, "feedback_stream")
    # The newer half of the days arrives first, so that the second delivery is late as a whole.
    middle = v.feedback().agg(F.expr("(min(ts) + max(ts)) div 2")).scalar()
    newer = F.coalesce(F.col("ts") > middle, F.lit(False))
    for part in (newer, ~newer):
        v.feedback().filter(part).write.mode("append").option("header", True).csv(f"{root}/in")
        source = feeds.feedback_source(spark, f"{root}/in")
        _drained(*feeds.stream_feedback_sink(source, f"{root}/out", f"{root}/rejected", f"{root}/state", once=True))
    good = feeds.settled_feedback(spark.read.parquet(f"{root}/out")).withColumn("accepted", F.lit(True))
    bad = spark.read.parquet(f"{root}/rejected").select("user_id", "item_id", "rating", "ts").withColumn("accepted", F.lit(False))
    return good.unionByName(bad)


@query
def q_stream_profile_ratings(v: Views) -> DataFrame:
    """All profile rating writes through the stream; the rating table their log amounts to."""
    spark, root = v.spark, scratch_path(v.spark, "profile_stream")
    writes = v.profile_writes().select(*upserts.WRITE_COLUMNS)
    writes.write.parquet(f"{root}/in")
    source = spark.readStream.schema(writes.schema).parquet(f"{root}/in")
    _drained(upserts.stream_profile_ratings(source, f"{root}/log", f"{root}/state", once=True))
    return upserts.current_profile_ratings(spark.read.parquet(f"{root}/log"))


@query
def q_ingest_feedback(v: Views) -> DataFrame:
    """All feedback in two deliveries, the older days last, and once more; stored ratings, their events and rejected rows."""
    spark, root = v.spark, scratch_path(v.spark, "feedback_ingest")
    feedback = reuse(v.feedback())
    middle = feedback.agg(F.expr("(min(ts) + max(ts)) div 2")).scalar()
    newer = F.coalesce(F.col("ts") > middle, F.lit(False))
    for part in (newer, ~newer, newer):
        feedback.filter(part).write.mode("append").option("header", True).csv(f"{root}/in")
        source = feeds.feedback_source(spark, f"{root}/in")
        _drained(ingest.ingest_feedback(source, f"{root}/out", f"{root}/state", once=True))
        ingest.feedback_store(f"{root}/out").compact(spark)
    outputs = []
    for name in (ingest.RATINGS, ingest.REJECTED):
        outputs.append(ingest.ingested(spark, f"{root}/out", name).select(F.lit(name).alias("output"), "user_id", "item_id", "rating", "ts"))
    raised = ingest.ingested(spark, f"{root}/out", ingest.RATE_EVENTS)
    stamp = F.unix_timestamp(F.try_to_timestamp("timestamp")).alias("ts")
    outputs.append(raised.select(F.lit("rate").alias("output"), "user_id", "item_id", F.col("metadata")["rating"].cast("double").alias("rating"), stamp))
    return outputs[0].unionByName(outputs[1]).unionByName(outputs[2])


@query
def q_ingest_events(v: Views) -> DataFrame:
    """All events as JSON files through one streaming query; accepted and rejected rows as stored."""
    spark, root = v.spark, scratch_path(v.spark, "event_ingest")
    v.events().select(*feeds.EVENT_COLUMNS).write.json(f"{root}/in")
    _drained(ingest.ingest_events(feeds.event_source(spark, f"{root}/in"), f"{root}/out", f"{root}/state", once=True))
    good = ingest.ingested(spark, f"{root}/out", ingest.ACCEPTED_EVENTS).withColumn("accepted", F.lit(True))
    both = good.unionByName(ingest.ingested(spark, f"{root}/out", ingest.REJECTED_EVENTS).withColumn("accepted", F.lit(False)))
    return both.select("timestamp", "event_type", "user_id", "item_id", F.col("metadata")["k"].alias("k"), "dt", "accepted")


@query
def q_profile_rating_store(v: Views) -> DataFrame:
    """All profile rating writes in four deliveries, compacted twice on the way; the rating table as it then reads."""
    spark, root = v.spark, scratch_path(v.spark, "profile_store")
    writes = reuse(v.profile_writes().select(*upserts.WRITE_COLUMNS))
    for part in (3, 1, 0, 2):
        writes.filter(F.col("write_no") % 4 == part).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(writes.schema).parquet(f"{root}/in")
        _drained(ingest.keep_profile_ratings(source, f"{root}/store", f"{root}/state", compact_every=2, once=True))
    return ingest.current_ratings(spark, f"{root}/store")


# Collaborative filtering ---------------------------------------------------------------------------------------------


def _model(v: Views):
    """The configured model, fitted on all training ratings."""
    if v.keeps_ratings:
        return als_ops.als_fit(v.train_test()[0])
    train = reuse(v.train_test()[0])
    model = als_ops.als_fit(train)
    release(train)
    return model


@query
def q_als_fit(v: Views) -> DataFrame:
    """Users and items of the model with the length and smallest entry of their factors."""
    model = _model(v)
    kinds = model.userFactors.withColumn("kind", F.lit("user")).unionByName(
        model.itemFactors.withColumn("kind", F.lit("item"))
    )
    return kinds.select(
        "kind",
        "id",
        F.size("features").cast("long").alias("factors"),
        (F.array_min("features") >= 0).alias("nonnegative"),
    )


@query
def q_als_predict(v: Views) -> DataFrame:
    """Test ratings of known users and items, each with the prediction that is the product of the stored factors."""
    model = _model(v.keep_ratings())
    # The model goes from users to items: factors of users are joined before it and those of items after it, where rows lie.
    test = v.train_test()[1].join(model.userFactors.selectExpr("id AS user_id", "features AS mine"), "user_id")
    predicted = als_ops.als_predict(model, test, keep=("mine",))
    predicted = predicted.join(model.itemFactors.selectExpr("id AS item_id", "features AS theirs"), "item_id")
    product = F.aggregate(F.zip_with("mine", "theirs", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    sound = F.coalesce(F.abs(F.col("prediction") - product) < 1e-4, F.lit(False))
    return predicted.select("user_id", "item_id", "rating", sound.alias("sound"))


def _per_user(candidates: DataFrame) -> DataFrame:
    """What is certain of a user's candidates: how many there are, all different, and none without a score."""
    return candidates.groupBy("user_id").agg(
        F.count("*").alias("candidates"),
        F.count_distinct("item_id").alias("items"),
        F.count(F.when(F.col("als_score").isNull() | F.isnan("als_score"), 1)).alias("without_score"),
    )


@query
def q_als_candidates_all(v: Views) -> DataFrame:
    return _per_user(als_ops.als_candidates_all(_model(v), BlendConfig().candidate_top_k))


@query
def q_als_candidates_subset(v: Views) -> DataFrame:
    model = _model(v.keep_ratings())
    return _per_user(als_ops.als_candidates_subset(model, v.train_test()[1], BlendConfig().candidate_top_k))


@query
def q_als_top_k(v: Views) -> DataFrame:
    """The pruned search over the whole model: per user whether scores are those of all pairs, and whether fewer were computed."""
    model, k = _model(v), BlendConfig().candidate_top_k
    pairs, compared = als_ops.als_top_k(model, k)
    every = als_ops.als_candidates_all(model, k)

    def scores(rows: DataFrame, name: str) -> DataFrame:
        falling = F.sort_array(F.collect_list("als_score"), asc=False)
        return rows.groupBy("user_id").agg(falling.alias(name), F.count_distinct("item_id").alias(f"{name}_items"))

    both = scores(pairs, "mine").join(scores(every, "theirs"), "user_id").join(compared, "user_id")
    near = F.forall(F.zip_with("mine", "theirs", lambda a, b: F.abs(a - b) < 1e-4), lambda same: F.coalesce(same, F.lit(False)))
    items = model.itemFactors.agg(F.count("*")).scalar()
    return both.select(
        "user_id",
        F.size("mine").cast("long").alias("candidates"),
        (near & (F.col("mine_items") == F.size("mine"))).alias("same_scores"),
        (F.col("compared") <= items).alias("no_more_pairs"),
    )


@query
def q_als_enriched(v: Views) -> DataFrame:
    """Per user the candidates and how many of them bear another title or other genres than the catalogue."""
    named = als_ops.als_enriched(als_ops.als_candidates_all(_model(v), BlendConfig().candidate_top_k), v.items())
    catalogue = v.items().select("item_id", F.struct("title", "genres").alias("card"))
    both = named.withColumn("mine", F.struct("title", "genres")).join(catalogue, "item_id", "left")
    none = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("genres"))
    differs = ~F.col("mine").eqNullSafe(F.coalesce("card", none))
    return both.groupBy("user_id").agg(F.count("*").alias("candidates"), F.count(F.when(differs, 1)).alias("different"))


@query
def q_serve_als_legacy(v: Views) -> DataFrame:
    """All requests with the model route allowed: stored lists, model lists and fallback lists all answer some."""
    direct = als_ops.als_enriched(als_ops.als_candidates_subset(_model(v), v.requests(), 20), v.items())
    config = ServeConfig(allow_als_legacy=True)
    answers = serving.serve_batch(v.requests(), v.merged(), _precomputed(v), _fallback(v), direct, config)
    return answers.select(
        "request_id", "user_id", "route", F.size("recommendations").cast("long").alias("recommended")
    )


@query
def q_als_grid(v: Views) -> DataFrame:
    """The configured grid; which trial is best follows from the errors."""
    train, test = (reuse(side) for side in v.train_test())
    best, trials = als_grid(train, test)
    for side in (train, test):
        release(side)
    lowest = min(trials, key=lambda t: (t["rmse"], t["trial_no"]))
    rows = tables.trial_rows(v.spark, trials).withColumn("sound", F.col("rmse").between(0, 10))
    return rows.select("trial_no", "rank", "reg_param", "max_iter", "sound", F.lit(best.rank == lowest["rank"]).alias("best_is_lowest"))


@query
def q_save_model_version(v: Views) -> DataFrame:
    """Two versions of one model: distinct names, the marker at the newer one, and each readable in full."""
    root, model = scratch_path(v.spark, "models"), _model(v)
    paths = [tables.save_model_version(model, root, v.spark) for _ in range(2)]
    named = F.col("version").rlike(r"^model-\d{8}T\d{12}-[0-9a-f]{8}$") & F.endswith("path", F.concat(F.lit("/versions/"), F.col("version")))
    marker = tables.latest_version(v.spark, root)
    users = ALSModel.load(paths[0]).userFactors.count()
    return marker.select(named.alias("named"), (F.col("path") == paths[1]).alias("newest"), F.lit(paths[0] != paths[1]).alias("distinct_paths"), F.lit(users).alias("users"))


@query
def q_load_als_model(v: Views) -> DataFrame:
    root = scratch_path(v.spark, "models")
    tables.save_model_version(_model(v), root, v.spark)
    loaded = tables.load_als_model(root)
    kinds = loaded.userFactors.withColumn("kind", F.lit("user")).unionByName(loaded.itemFactors.withColumn("kind", F.lit("item")))
    return kinds.select("kind", "id", F.size("features").cast("long").alias("factors"))


def _violations(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """What must not be: seen items, gaps in the ranks, signals out of range. All counts are zero."""
    outside = F.greatest(*[F.when(F.col(c).between(0, 1), 0).otherwise(1) for c in ("als_norm", "popularity_norm", "recency_norm")])
    per_user = stored.groupBy("user_id").agg(F.max("rank").alias("last"), F.count("*").alias("rows"), F.sum(outside).alias("outside"))
    repeated = stored.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi")
    counted = per_user.agg(F.count(F.when(F.col("last") != F.col("rows"), 1)).alias("gaps"), F.coalesce(F.sum("outside"), F.lit(0)).alias("outside"))
    return counted.withColumn("seen", repeated.agg(F.count("*").alias("n")).scalar())


@query
def q_hybrid_precomputed_als(v: Views) -> DataFrame:
    train = v.keep_ratings().train_test()[0]
    candidates = als_ops.als_candidates_all(_model(v), PrecomputeConfig().top_n)
    return _violations(hybrid_plan.hybrid_precomputed(candidates, train, v.items()), train)


@query
def q_hybrid_ranking_eval_als(v: Views) -> DataFrame:
    """Ranking metrics of the model's own candidates: each between 0 and 1."""
    train, test = v.keep_ratings().train_test()
    candidates = als_ops.als_candidates_subset(_model(v), test, BlendConfig().candidate_top_k)
    metrics = hybrid_plan.hybrid_ranking_eval(candidates, train, test, v.items())
    return metrics.select(F.col("k").cast("long").alias("k"), *[F.col(c).between(0, 1).alias(c) for c in ("precision_at_k", "recall_at_k", "ndcg_at_k")])


@query
def q_published_fallback(v: Views) -> DataFrame:
    """Fallback lists of two runs and one that fails on the way: the current release is that of the last whole run."""
    spark, root = v.spark, scratch_path(v.spark, "releases")

    def write(top_n: int, fail: bool = False) -> Callable[[str], None]:
        def run(folder: str) -> None:
            tables.write_gold_fallback(fallback.fallback_all(v.ratings(), v.items(), FallbackConfig(top_n=top_n)), f"{folder}/gold_fallback")
            if fail:
                raise InterruptedError

        return run

    releases.publish(spark, root, "run-1", write(3))
    releases.publish(spark, root, "run-2", write(10))
    try:
        releases.publish(spark, root, "run-3", write(5, fail=True))
    except InterruptedError:
        pass
    lists = tables.read_gold_fallback(spark, f"{releases.current(spark, root)}/gold_fallback")
    return rounded(longs(lists, "rank"))


@query
def q_retrain_job(v: Views) -> DataFrame:
    """The whole job on stored silver tables and feedback, with the configured grid; all that it published."""
    spark, root = v.spark, scratch_path(v.spark, "store")
    paths = StorePaths(
        **{name: f"{root}/{name}" for name in StorePaths.__dataclass_fields__},
    )
    tables.write_silver_ratings(v.ratings(), paths.silver_ratings)
    tables.write_silver_items(v.items(), paths.silver_items)
    v.feedback().write.option("header", True).csv(paths.feedback)
    result = retrain_job(spark, paths, TrainingConfig())
    lists = tables.read_gold_fallback(spark, paths.gold_fallback)
    lists = lists.select("fallback_type", "genre", F.col("rank").cast("long").alias("rank"), F.col("item_id").cast("long").alias("value"))

    def fact(name: str, value) -> DataFrame:
        column = value if isinstance(value, Column) else F.lit(value)
        return spark.range(1).select(F.lit(name).alias("fallback_type"), F.lit(None).cast("string").alias("genre"), F.lit(0).cast("long").alias("rank"), column.cast("long").alias("value"))

    stored = tables.read_gold_precomputed(spark, paths.gold_precomputed)
    bad = _violations(stored, v.merged())
    trials = spark.read.schema(TRIALS).parquet(paths.trials)
    metrics = spark.read.parquet(paths.metrics)
    known = tables.latest_version(spark, paths.models).filter(F.col("path") == result["model_path"]).count()
    facts = [
        fact("trials", trials.filter("rmse IS NOT NULL").agg(F.count("*")).scalar()),
        fact("metrics", metrics.filter("precision_at_k BETWEEN 0 AND 1 AND ndcg_at_k BETWEEN 0 AND 1").agg(F.count("*")).scalar()),
        fact("models", known),
        fact("violations", bad.select(F.col("gaps") + F.col("outside") + F.col("seen")).scalar()),
    ]
    for one in facts:
        lists = lists.unionByName(one)
    return lists
