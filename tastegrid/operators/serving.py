"""Answering a table of recommendation requests in one query.

A stored recommendation list is short (the precomputed top-n of a user, the top-n of a genre), so each list is one
array, joined once per request and cut and filtered within the row.  Requests never fan out, and the list side of every
join holds one row per key, so a hot user or genre only makes its own requests many; those are split (see ``skew``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastegrid.config import ServeConfig
from tastegrid.functions import matches_genre, primary_genre, request_key, user_bucket
from tastegrid.operators.skew import MARK, distinct_for_join, group_for_join, matching

# The wording.
GENRE_REASON = "Matches requested genre: "
GLOBAL_REASON = "Top trending fallback recommendation."
TRENDING_REASON = "Top trending by global popularity."
BY_GENRE_REASON = "Popular in genre: "
ALS_REASON = "Users similar to you liked this."

# The fields of a recommendation in output order.
REC_FIELDS = {
    "item_id": "int",
    "title": "string",
    "genres": "string",
    "score": "double",
    "als_score": "double",
    "content_score": "double",
    "rank": "int",
    "explain": "string",
}
REC_LIST = "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in REC_FIELDS.items()) + ">>"


def _rec_columns(columns: list[str]) -> list[Column]:
    """The fields of a recommendation, typed and with defaults; fields that are not there are null."""
    defaults = {"score": F.lit(0.0), "explain": F.lit("")}
    fields = []
    for name, kind in REC_FIELDS.items():
        value = (F.col(name) if name in columns else F.lit(None)).cast(kind)
        fields.append((F.coalesce(value, defaults[name]) if name in defaults else value).alias(name))
    return fields


def normalize_recs(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """The output columns of a recommendation, led by ``keys``."""
    return rows.select(*keys, *_rec_columns(rows.columns))


def _collected(*order: Column) -> Column:
    """The recommendation rows of a group as one array in the given order."""
    keys = [key.alias(f"key_{i}") for i, key in enumerate(order)]
    rows = F.collect_list(F.struct(*keys, F.struct(*REC_FIELDS).alias("rec")))
    return F.transform(F.sort_array(rows), lambda row: row["rec"])


def _explained(recs: Column, reason: Column) -> Column:
    """The recommendations with one reason for all and no place of their own."""
    return F.transform(
        recs, lambda rec: rec.withField("explain", reason).withField("rank", F.lit(None).cast("int"))
    )


def _or_empty(recs: Column) -> Column:
    return F.coalesce(recs, F.array().cast(REC_LIST))


def _first(recs: Column, n: Column | int) -> Column:
    return F.slice(recs, F.lit(1), F.lit(n) if isinstance(n, int) else n)


# Rows of some users --------------------------------------------------------------------------------------------------

#: Where a bucketed table's ``user_bucket`` column carries the number of buckets.
BUCKET_COUNT = "user_buckets"


def bucket_count(table: DataFrame) -> int | None:
    """How many user buckets a stored table has; None if it is not bucketed or does not say."""
    return table.schema["user_bucket"].metadata.get(BUCKET_COUNT) if "user_bucket" in table.columns else None


def of_users(table: DataFrame, users: DataFrame, marked: bool = False) -> DataFrame:
    """The table's rows of the given users; ``marked`` if they are to be grouped by user (see ``skew.matching``).

    Of a table that knows its number of buckets, only the folders of the users' buckets are read: their numbers, as many
    as there are buckets at most, are one value that Spark computes before it lists the files.
    """
    buckets = bucket_count(table)
    if buckets is not None:
        asked = users.agg(F.collect_set(user_bucket(buckets=buckets)).alias("asked")).scalar()
        table = table.filter(F.array_contains(asked, F.col("user_bucket")))
    return matching(table, users, "user_id", marked=marked)


def _by_user(table: DataFrame) -> list[str]:
    """The user, and the mark of rows that already lie by user."""
    return ["user_id", *([MARK] if MARK in table.columns else [])]


# Requests ------------------------------------------------------------------------------------------------------------


def prepare_requests(requests: DataFrame, config: ServeConfig = ServeConfig()) -> DataFrame:
    """Fill in the default size and read an empty genre as none."""
    size = F.coalesce(F.nullif(F.col("top_n"), F.lit(0)), F.lit(config.default_top_n)).cast("int")
    wanted = F.when(F.col("genre") != "", F.col("genre"))
    return requests.select("request_id", "user_id", size.alias("top_n"), wanted.alias("genre"))


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One row per normalised request of a batch, with how many requests it stands for."""
    keyed = requests.withColumn("request_key", request_key("user_id", "top_n", "genre"))
    return keyed.groupBy("request_key").agg(F.count(F.lit(1)).alias("requests"))


def user_has_history(requests: DataFrame, ratings: DataFrame) -> DataFrame:
    """Add ``has_history``: the user has rated something.  Only the ratings of users who ask are read."""
    known = distinct_for_join(of_users(ratings, requests), "user_id").withColumn("has_history", F.lit(True))
    return requests.join(known, "user_id", "left").fillna(False, ["has_history"])


# Stored lists --------------------------------------------------------------------------------------------------------


def stored_lists(precomputed: DataFrame) -> DataFrame:
    """Each user's precomputed recommendations as one array in rank order."""
    rows = normalize_recs(precomputed, *_by_user(precomputed))
    lists = group_for_join(rows, "user_id").agg(_collected(F.col("rank")).alias("stored"))
    return lists.select("user_id", "stored")


def serve_als_legacy(als_recommendations: DataFrame) -> DataFrame:
    """Direct model recommendations (with title and genres) as response rows."""
    fixed = {
        "score": F.col("als_score"),
        "content_score": F.lit(0.0),
        "rank": F.lit(None),
        "explain": F.lit(ALS_REASON),
    }
    return normalize_recs(als_recommendations.withColumns(fixed), *_by_user(als_recommendations))


def als_lists(als_recommendations: DataFrame) -> DataFrame:
    """Each user's direct model recommendations as one array, best first."""
    rows = serve_als_legacy(als_recommendations)
    lists = group_for_join(rows, "user_id").agg(_collected(-F.col("score"), F.col("item_id")).alias("direct"))
    return lists.select("user_id", "direct")


def global_list(fallback: DataFrame) -> DataFrame:
    """The overall top list in one row and column, worded both as a fallback (``listed``) and as trending."""
    rows = fallback.filter(F.col("fallback_type") == "global").withColumn("score", F.col("popularity_score"))
    one = normalize_recs(rows).agg(_collected(F.col("rank"), F.col("item_id")).alias("recs"))
    return one.select(
        F.struct(
            _explained(F.col("recs"), F.lit(GLOBAL_REASON)).alias("listed"),
            _explained(F.col("recs"), F.lit(TRENDING_REASON)).alias("trending"),
        )
    )


def genre_lists(fallback: DataFrame) -> DataFrame:
    """The top list of each genre, told apart without regard to case, as one array."""
    rows = fallback.filter(F.col("fallback_type") == "genre").withColumn("score", F.col("popularity_score"))
    named = normalize_recs(rows, F.lower("genre").alias("genre_key"))
    lists = group_for_join(named, "genre_key").agg(_collected(F.col("rank"), F.col("item_id")).alias("genre_list"))
    return lists.select("genre_key", "genre_list")


def top_trending(fallback: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of the overall list with their reason."""
    rows = fallback.filter((F.col("fallback_type") == "global") & (F.col("rank") <= n))
    return rows.select("rank", "item_id", "title", "genres", "popularity_score", F.lit(TRENDING_REASON).alias("explain"))


def top_by_genre(fallback: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each genre in ``wanted`` (column ``genre``) with their reason."""
    rows = fallback.filter((F.col("fallback_type") == "genre") & (F.col("rank") <= n))
    rows = rows.withColumn("genre_key", F.lower("genre")).drop("genre")
    asked = wanted.select("genre", F.lower("genre").alias("genre_key")).distinct()
    reason = F.concat(F.lit(BY_GENRE_REASON), F.col("genre")).alias("explain")
    return asked.join(rows, "genre_key").select(
        "genre", "rank", "item_id", "title", "genres", "popularity_score", reason
    )


# Answers -------------------------------------------------------------------------------------------------------------


def serve_hybrid(requests: DataFrame, precomputed: DataFrame) -> DataFrame:
    """Add ``hybrid``: the user's stored rows that match the requested genre, cut to the requested size.

    Only the stored rows of users who ask are read.  Rows keep their stored rank, so ranks may have gaps after the genre
    filter.
    """
    joined = requests.join(stored_lists(of_users(precomputed, requests, marked=True)), "user_id", "left")
    fitting = F.filter(
        "stored", lambda rec: F.col("genre").isNull() | matches_genre(rec["genres"], F.col("genre"))
    )
    return joined.withColumn("hybrid", _or_empty(_first(fitting, F.col("top_n")))).drop("stored")


def with_direct(requests: DataFrame, als_recommendations: DataFrame | None, config: ServeConfig) -> DataFrame:
    """Add ``direct``: model recommendations where that route is allowed, else an empty list."""
    if als_recommendations is None or not config.allow_als_legacy:
        return requests.withColumn("direct", F.array().cast(REC_LIST))
    joined = requests.join(als_lists(of_users(als_recommendations, requests, marked=True)), "user_id", "left")
    return joined.withColumn("direct", _or_empty(_first(F.col("direct"), F.col("top_n"))))


def with_route(answers: DataFrame) -> DataFrame:
    """Add ``route``: stored rows for users with history, else model rows, else the fallback lists."""
    stored = F.col("has_history") & (F.size("hybrid") > 0)
    direct = F.col("has_history") & (F.size("direct") > 0)
    route = F.when(stored, "hybrid").when(direct, "als_legacy").otherwise("fallback")
    return answers.withColumn("route", route)


def route_requests(
    requests: DataFrame,
    ratings: DataFrame,
    precomputed: DataFrame,
    als_recommendations: DataFrame | None = None,
    config: ServeConfig = ServeConfig(),
) -> DataFrame:
    """Requests with their route and the lists it was chosen from."""
    known = user_has_history(prepare_requests(requests, config), ratings)
    return with_route(with_direct(serve_hybrid(known, precomputed), als_recommendations, config))


def selected_genre(answers: DataFrame, everyone: Column) -> DataFrame:
    """Add ``selected_genre``: the requested genre, else the first genre of the first recommendation."""
    own = F.when(F.col("route") == "hybrid", F.col("hybrid")).when(F.col("route") == "als_legacy", F.col("direct"))
    leading = F.get(F.coalesce(own, everyone["listed"]), F.lit(0))["genres"]
    derived = F.trim(primary_genre(leading))
    return answers.withColumn("selected_genre", F.coalesce("genre", F.when(derived != "", derived)))


def serve_fallback(answers: DataFrame, everyone: Column) -> DataFrame:
    """Add ``recommendations``: those of the route, with the genre list, else the overall list, for the fallback.

    ``answers`` carries ``genre_list``, the list of the selected genre; a requested genre is always the selected one.
    """
    size = F.col("top_n")
    reason = F.concat(F.lit(GENRE_REASON), F.col("genre"))
    of_genre = F.when(F.col("genre").isNotNull() & (F.size("genre_list") > 0), F.col("genre_list"))
    listed = F.when(of_genre.isNotNull(), _explained(_first(of_genre, size), reason)).otherwise(
        _first(everyone["listed"], size)
    )
    chosen = F.when(F.col("route") == "hybrid", F.col("hybrid")).when(F.col("route") == "als_legacy", F.col("direct"))
    return answers.withColumn("recommendations", F.coalesce(chosen, listed))


def because_you_watched(recommendations: Column, length: int) -> Column:
    """Item, title and reason of the first few recommendations."""
    return F.transform(
        _first(recommendations, length),
        lambda rec: F.struct(rec["item_id"].alias("item_id"), rec["title"].alias("title"), rec["explain"].alias("explain")),
    )


def score_rows(recommendations: Column) -> Column:
    """Only the scores of the recommendations."""
    names = ("item_id", "score", "als_score", "content_score")
    return F.transform(recommendations, lambda rec: F.struct(*[rec[name].alias(name) for name in names]))


def serve_batch(
    requests: DataFrame,
    ratings: DataFrame,
    precomputed: DataFrame,
    fallback: DataFrame,
    als_recommendations: DataFrame | None = None,
    config: ServeConfig = ServeConfig(),
) -> DataFrame:
    """One nested response row per request; ``short`` marks those with fewer recommendations than asked for.

    Requests (``request_id``, ``user_id``, ``top_n``, ``genre``) are shuffled once, by user, for both the history check
    and the stored lists.  The per-genre lists are as small as the genre vocabulary; the overall list is one value.
    """
    everyone = F.col("everyone")
    routed = route_requests(requests, ratings, precomputed, als_recommendations, config)
    routed = routed.withColumn("everyone", global_list(fallback).scalar())
    asked = selected_genre(routed, everyone).withColumn("genre_key", F.lower("selected_genre"))
    joined = asked.join(genre_lists(fallback), "genre_key", "left").withColumn(
        "genre_list", _or_empty(F.col("genre_list"))
    )
    answered = serve_fallback(joined, everyone)
    wide = F.least(F.greatest(F.col("top_n"), F.lit(config.trending_min)), F.lit(config.trending_max))
    by_genre_reason = F.concat(F.lit(BY_GENRE_REASON), F.col("selected_genre"))
    return answered.select(
        "request_id",
        "user_id",
        "top_n",
        "genre",
        "route",
        "selected_genre",
        "recommendations",
        (F.size("recommendations") < F.col("top_n")).alias("short"),
        score_rows(F.col("recommendations")).alias("scores"),
        because_you_watched(F.col("recommendations"), config.because_length).alias("because_you_watched"),
        _first(everyone["trending"], wide).alias("top_trending"),
        _explained(_first(F.col("genre_list"), wide), by_genre_reason).alias("top_by_genre"),
    )


#: A key that more requests ask for is answered in several copies, each for so many of them.
COPY_REQUESTS = 100_000


def serve_distinct(
    requests: DataFrame,
    ratings: DataFrame,
    precomputed: DataFrame,
    fallback: DataFrame,
    als_recommendations: DataFrame | None = None,
    config: ServeConfig = ServeConfig(),
    copy_requests: int = COPY_REQUESTS,
) -> DataFrame:
    """The rows of ``serve_batch``, with each distinct request answered once.

    Requests are equal if user, size and genre are, after defaults are filled in; they are counted before the shuffle, so
    a request that makes up a third of the batch is one row to answer. Answers go back to their requests by key; the
    answer of a key with more than ``copy_requests`` requests is copied, and its requests are dealt over the copies. The
    hot keys, at most one per ``copy_requests`` requests, are broadcast.
    """
    key = ["user_id", "top_n", "genre"]
    prepared = prepare_requests(requests, config)
    asked = prepared.groupBy(*key).agg(F.count("*").alias("_requests"))
    answers = serve_batch(asked.select(F.lit(None).cast("long").alias("request_id"), *key), ratings, precomputed, fallback, als_recommendations, config)
    copies = F.ceil(F.col("_requests") / copy_requests).cast("int")
    hot = asked.filter(F.col("_requests") > copy_requests).select(*key, copies.alias("_copies"))

    def named(df: DataFrame, mark: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{mark}{c}" for c in key})

    def same(mark: str) -> Column:
        one = F.lit(True)
        for c in key:
            one = one & F.col(c).eqNullSafe(F.col(f"{mark}{c}"))
        return one

    def with_copies(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(named(hot, "_hot_")), same("_hot_"), "left")
        return joined.withColumn("_copies", F.coalesce("_copies", F.lit(1))).drop(*[f"_hot_{c}" for c in key])

    dealt = with_copies(prepared).withColumn("_copy", F.pmod(F.xxhash64("request_id"), F.col("_copies")).cast("int"))
    copied = with_copies(answers).withColumn("_answer_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    copied = named(copied.drop("request_id", "_copies"), "_answer_")
    joined = dealt.join(copied, same("_answer_") & (F.col("_copy") == F.col("_answer_copy")))
    return joined.select(*answers.columns)
