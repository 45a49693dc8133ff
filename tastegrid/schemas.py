"""Explicit schemas of the stored tables; nothing is ever inferred."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


RATINGS = _schema(user_id=IntegerType(), item_id=IntegerType(), rating=DoubleType(), ts=LongType())

ITEMS = _schema(item_id=IntegerType(), title=StringType(), genres=StringType())

SILVER_RATINGS = StructType(RATINGS.fields + [StructField("user_bucket", IntegerType(), True)])

EVENTS = _schema(
    timestamp=StringType(),
    event_type=StringType(),
    user_id=IntegerType(),
    item_id=IntegerType(),
    metadata=MapType(StringType(), StringType()),
)

FALLBACK = _schema(
    fallback_type=StringType(),
    genre=StringType(),
    rank=IntegerType(),
    item_id=IntegerType(),
    title=StringType(),
    genres=StringType(),
    rating_count=LongType(),
    avg_rating=DoubleType(),
    popularity_score=DoubleType(),
)

PRECOMPUTED = _schema(
    user_id=IntegerType(),
    item_id=IntegerType(),
    als_score=DoubleType(),
    content_score=DoubleType(),
    max_genre_weight=DoubleType(),
    genre_match_count=IntegerType(),
    title=StringType(),
    genres=StringType(),
    primary_genre=StringType(),
    release_year=IntegerType(),
    rating_count=LongType(),
    avg_rating=DoubleType(),
    popularity_score=DoubleType(),
    popularity_norm=DoubleType(),
    als_norm=DoubleType(),
    hybrid_score=DoubleType(),
    recency_norm=DoubleType(),
    genre_rank=IntegerType(),
    rerank_score=DoubleType(),
    rank=IntegerType(),
    favorite_genre=StringType(),
    favorite_genre_weight=DoubleType(),
    anchor_title=StringType(),
    explain_because=StringType(),
    explain_social=StringType(),
    explain_genre=StringType(),
    explain=StringType(),
    route=StringType(),
    score=DoubleType(),
    user_bucket=IntegerType(),
)

TRIALS = _schema(
    run_id=StringType(), trial_no=IntegerType(), rank=IntegerType(), reg_param=DoubleType(), max_iter=IntegerType(), rmse=DoubleType()
)
