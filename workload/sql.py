"""The same results as plain SQL over the driver's tables, for comparison in another engine.

Written row by row (fan out, join, group, window), unlike the Spark operators, so that the two check each other.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Domain views, as in ``workload.views``.
VIEWS: dict[str, str] = {
    "ratings_raw": """
        SELECT CAST(o.o_custkey AS INT) AS user_id, CAST(l.l_partkey AS INT) AS item_id,
               CASE WHEN l.l_quantity <> 13 THEN CAST(floor((l.l_quantity - 1) / 4) AS DOUBLE) / 2 END AS rating,
               CAST(datediff('day', DATE '1970-01-01', make_date(year(l.l_shipdate), 1, 1)) AS BIGINT) * 86400 AS ts,
               l.l_orderkey AS src_order, l.l_linenumber AS src_line
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "ratings": """
        SELECT user_id, item_id, max(rating) AS rating, ts FROM ratings_raw
        WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND ts IS NOT NULL AND rating BETWEEN 0.5e0 AND 5.0e0
        GROUP BY user_id, item_id, ts""",
    "items_raw": """
        SELECT CAST(p_partkey AS INT) AS item_id,
               CASE WHEN p_size % 10 = 0 THEN p_name
                    ELSE concat(p_name, ' (', CAST(1950 + p_size AS VARCHAR), ')') END AS title,
               CASE WHEN p_partkey % 97 = 0 THEN '(no genres listed)'
                    WHEN p_partkey % 89 = 0 THEN concat(split_part(p_name, ' ', 1), '||', p_type)
                    ELSE concat(replace(p_name, ' ', '|'), '|', p_type) END AS genres
        FROM part""",
    "items": """
        SELECT item_id, title, genres FROM (
          SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY title, genres) AS rn FROM items_raw
          WHERE item_id IS NOT NULL AND title IS NOT NULL AND genres IS NOT NULL) WHERE rn = 1""",
    "candidates": """
        SELECT user_id, item_id,
               0.25e0 + CAST((CAST(user_id AS BIGINT) * 31 + CAST(item_id AS BIGINT) * 17) % 41 AS DOUBLE) / 8 AS als_score
        FROM (SELECT DISTINCT user_id,
                CASE WHEN step = 0 THEN item_id
                     ELSE CAST((CAST(user_id AS BIGINT) * 31 + CAST(item_id AS BIGINT) * 17 + step * 7919)
                               % (SELECT max(p_partkey) + 4 FROM part) AS INT) END AS item_id
              FROM (SELECT DISTINCT user_id, item_id FROM ratings) p, (VALUES (0), (1), (2), (3)) s(step)) c""",
    "split_ratings": """
        SELECT *, (second_step * 48271 % 2147483647) % 10000 < 2000 AS is_test FROM (
          SELECT *, ((first_step + item_id) * 69621) % 2147483647 AS second_step FROM (
            SELECT *, (CAST(user_id AS BIGINT) * 48271 + 42) % 2147483647 AS first_step FROM ratings))""",
    "train": "SELECT user_id, item_id, rating, ts FROM split_ratings WHERE NOT is_test",
    "test": "SELECT user_id, item_id, rating, ts FROM split_ratings WHERE is_test",
    "behaviour": """
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp",
               CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) * 86400 AS day_ts,
               CASE lower(trim(event_type)) WHEN 'purchase' THEN 'rate' WHEN 'signup' THEN 'skip'
                    ELSE lower(trim(event_type)) END AS event_type,
               CAST(user_id AS INT) AS user_id, CAST(json_extract_string(props, '$.k') AS INT) AS item_id,
               value, json_extract_string(props, '$.k') AS k
        FROM events""",
    "feedback": """
        SELECT user_id, item_id, CAST(floor(value % 13) AS DOUBLE) / 2 AS rating, day_ts AS ts
        FROM behaviour WHERE event_type = 'rate'""",
    "merged": """
        SELECT user_id, item_id, max(rating) AS rating, ts FROM (
          SELECT user_id, item_id, rating, ts FROM ratings UNION ALL SELECT user_id, item_id, rating, ts FROM feedback)
        WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND rating BETWEEN 0.5e0 AND 5.0e0
        GROUP BY user_id, item_id, ts""",
    "requests_raw": """
        SELECT n + base AS request_id, CAST(n + base AS INT) AS user_id,
               CAST(CASE n % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 20 END AS INT) AS top_n,
               CASE n % 5 WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'red' WHEN 3 THEN 'no-such-genre' WHEN 4 THEN 'Bolt' END AS genre
        FROM (SELECT c_custkey AS n, 0 AS base FROM customer UNION ALL SELECT s_suppkey, 900000 FROM supplier)""",
    "profiles_raw": """
        SELECT c_custkey AS profile_id, c_nationkey AS account_id, concat(' ', c_name, ' ') AS profile_name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'ca_nhan_hoa' WHEN 'MACHINERY' THEN 'so_thich_ban_dau' END AS mode,
               CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN CAST(c_custkey AS INT) END AS user_id,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Economy' END AS preferred_genre,
               CASE WHEN c_acctbal >= 0 THEN 'hoat_dong' ELSE 'ngung' END AS status
        FROM customer""",
    "profiles": """
        SELECT profile_id, account_id, trim(profile_name) AS profile_name,
               CASE WHEN mode = 'ca_nhan_hoa' THEN 'ca_nhan_hoa' ELSE 'so_thich_ban_dau' END AS mode,
               coalesce(user_id, CASE WHEN mode = 'ca_nhan_hoa' THEN 2 ELSE CAST(account_id + 900000 AS INT) END) AS user_id,
               preferred_genre, status
        FROM profiles_raw""",
    "profile_requests": """
        SELECT o.o_orderkey AS request_id, p.profile_id, p.user_id, 10 AS top_n,
               coalesce(CASE WHEN o.o_orderstatus = 'F' THEN 'red' END, p.preferred_genre) AS genre
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN profiles p ON p.profile_id = o.o_custkey
         AND p.account_id = c.c_nationkey + CASE WHEN o.o_orderpriority = '5-LOW' THEN 1 ELSE 0 END""",
    "item_genres": "SELECT item_id, unnest(string_split(genres, '|')) AS genre FROM items",
    "features": """
        SELECT item_id, title, genres, string_split(genres, '|')[1] AS primary_genre,
               TRY_CAST(nullif(regexp_extract(title, '\\((\\d{4})\\)\\s*$', 1), '') AS INT) AS release_year
        FROM items""",
}


def stats(ratings: str) -> str:
    return f"""SELECT item_id, count(*) AS rating_count, avg(rating) AS avg_rating,
                      avg(rating) * ln(1 + count(*)) AS popularity_score FROM {ratings} GROUP BY item_id"""


def fallback(ratings: str, top_n: int) -> dict[str, str]:
    """Views ``fb_global`` and ``fb_genre``."""
    order = "floor(popularity_score * 1e9 + 0.5e0) DESC, rating_count DESC, item_id"
    return {
        "fb_stats": f"SELECT * FROM ({stats(ratings)}) WHERE rating_count >= 20",
        "fb_global": f"""
            SELECT 'global' AS fallback_type, CAST(NULL AS VARCHAR) AS genre, row_number() OVER (ORDER BY {order}) AS rank,
                   item_id, title, genres, rating_count, avg_rating, popularity_score
            FROM (SELECT * FROM fb_stats JOIN items USING (item_id) ORDER BY {order} LIMIT {top_n})""",
        "fb_genre_stats": f"""
            SELECT genre, item_id, title, genres, count(*) AS rating_count, avg(rating) AS avg_rating,
                   avg(rating) * ln(1 + count(*)) AS popularity_score
            FROM {ratings} JOIN (SELECT *, unnest(string_split(genres, '|')) AS genre FROM items) g USING (item_id)
            GROUP BY genre, item_id, title, genres HAVING count(*) >= 20""",
        "fb_genre": f"""
            SELECT 'genre' AS fallback_type, genre, rank, item_id, title, genres, rating_count, avg_rating, popularity_score
            FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY {order}) AS rank FROM fb_genre_stats)
            WHERE rank <= {top_n}""",
        "fb_all": "SELECT * FROM fb_global UNION ALL SELECT * FROM fb_genre",
    }


def popular(ratings: str) -> dict[str, str]:
    return {
        "pop": f"""
            SELECT *, CASE WHEN max(popularity_score) OVER () > 0
                           THEN popularity_score / max(popularity_score) OVER () ELSE 0e0 END AS popularity_norm
            FROM ({stats(ratings)})"""
    }


def tastes(ratings: str) -> dict[str, str]:
    """Views ``profile`` and ``anchors``."""
    return {
        "genre_rows": f"""SELECT r.*, g.genre FROM {ratings} r JOIN item_genres g ON r.item_id = g.item_id
                          WHERE length(trim(g.genre)) > 0""",
        "genre_totals": """
            SELECT user_id, genre, count(*) AS genre_interactions, avg(rating) AS genre_avg_rating,
                   sum(rating) + 0.25e0 * count(*) AS raw FROM genre_rows GROUP BY user_id, genre""",
        "profile": """
            SELECT user_id, genre, genre_interactions, genre_avg_rating,
                   CASE WHEN max(raw) OVER (PARTITION BY user_id) > 0
                        THEN raw / max(raw) OVER (PARTITION BY user_id) ELSE 0e0 END AS genre_weight,
                   row_number() OVER (PARTITION BY user_id ORDER BY raw DESC, genre_interactions DESC, genre) AS favorite_rank
            FROM genre_totals""",
        "anchors": """
            SELECT user_id, genre, item_id AS anchor_item_id, title AS anchor_title, rating AS anchor_rating FROM (
              SELECT g.*, i.title, row_number() OVER (PARTITION BY user_id, genre
                       ORDER BY rating DESC, ts DESC, g.item_id) AS rn
              FROM genre_rows g JOIN items i ON g.item_id = i.item_id) WHERE rn = 1""",
    }


def contents(candidates: str) -> dict[str, str]:
    """View ``content`` over ``candidates``; needs ``profile``."""
    return {
        "content": f"""
            SELECT c.user_id, c.item_id, c.als_score, avg(coalesce(p.genre_weight, 0e0)) AS content_score,
                   max(coalesce(p.genre_weight, 0e0)) AS max_genre_weight, count(p.genre_weight) AS genre_match_count
            FROM {candidates} c
            LEFT JOIN (SELECT * FROM item_genres WHERE length(trim(genre)) > 0) g ON c.item_id = g.item_id
            LEFT JOIN profile p ON p.user_id = c.user_id AND p.genre = g.genre
            GROUP BY c.user_id, c.item_id, c.als_score"""
    }


NORM = "greatest(0e0, least(1e0, (als_score - 0.5e0) / 4.5e0))"


def hybrid(ratings: str = "ratings", candidates: str = "candidates", top_n: int = 10) -> dict[str, str]:
    """View ``recs``: explained recommendations."""
    quality = "floor(hybrid_score * 1e9 + 0.5e0) DESC, floor(popularity_norm * 1e9 + 0.5e0) DESC, item_id"
    return {
        **popular(ratings),
        **tastes(ratings),
        "fresh": f"""SELECT * FROM {candidates} c WHERE NOT EXISTS
                     (SELECT 1 FROM {ratings} r WHERE r.user_id = c.user_id AND r.item_id = c.item_id)""",
        **contents("fresh"),
        "base": f"""
            SELECT *, 0.7e0 * als_norm + 0.3e0 * content_score AS hybrid_score FROM (
              SELECT c.*, f.title, f.genres, f.primary_genre, f.release_year, p.rating_count, p.avg_rating,
                     p.popularity_score, coalesce(p.popularity_norm, 0e0) AS popularity_norm, {NORM} AS als_norm
              FROM content c LEFT JOIN features f ON c.item_id = f.item_id LEFT JOIN pop p ON c.item_id = p.item_id)""",
        "extent": "SELECT min(release_year) AS lo, max(release_year) AS hi FROM base",
        "placed": f"""
            SELECT b.*, CASE WHEN release_year IS NOT NULL AND hi > lo
                             THEN CAST(release_year - lo AS DOUBLE) / (hi - lo) ELSE 0e0 END AS recency_norm,
                   row_number() OVER (PARTITION BY user_id, primary_genre ORDER BY {quality}) AS genre_rank
            FROM base b, extent""",
        "scored": """
            SELECT *, hybrid_score + 0.12e0 * max_genre_weight + 0.08e0 * popularity_norm + 0.03e0 * recency_norm
                      - 0.08e0 * (genre_rank - 1) AS rerank_score FROM placed""",
        "best": f"""
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                             ORDER BY floor(rerank_score * 1e9 + 0.5e0) DESC, {quality}) AS rank FROM scored) WHERE rank <= {top_n}""",
        "told": """
            SELECT b.*, fav.genre AS favorite_genre, fav.genre_weight AS favorite_genre_weight, a.anchor_title,
                   'Because you liked ' || coalesce(a.anchor_title, 'similar movies') AS explain_because,
                   'Users similar to you liked this (' || CAST(coalesce(b.rating_count, 0) AS VARCHAR) || ' ratings)'
                     AS explain_social,
                   'Matches your favorite genre: ' || coalesce(b.primary_genre, fav.genre, 'Mixed') AS explain_genre
            FROM best b
            LEFT JOIN profile fav ON fav.user_id = b.user_id AND fav.favorite_rank = 1
            LEFT JOIN anchors a ON a.user_id = b.user_id AND a.genre = b.primary_genre""",
        "recs": """
            SELECT *, explain_because || '; ' || explain_social || '; ' || explain_genre AS "explain",
                   'hybrid' AS route, rerank_score AS score, CAST(user_id % 64 AS INT) AS user_bucket FROM told""",
    }


HYBRID_SHOWN = """user_id, item_id, als_score, round(content_score, 9) AS content_score,
    round(max_genre_weight, 9) AS max_genre_weight, CAST(genre_match_count AS BIGINT) AS genre_match_count, title, genres,
    primary_genre, release_year, rating_count, round(avg_rating, 9) AS avg_rating,
    round(popularity_score, 9) AS popularity_score, round(popularity_norm, 9) AS popularity_norm,
    round(als_norm, 9) AS als_norm, round(hybrid_score, 9) AS hybrid_score, round(recency_norm, 9) AS recency_norm,
    genre_rank, round(rerank_score, 9) AS rerank_score, rank, favorite_genre,
    round(favorite_genre_weight, 9) AS favorite_genre_weight, anchor_title, explain_because, explain_social,
    explain_genre, "explain" """

PRECOMPUTED_SHOWN = HYBRID_SHOWN + ", route, round(score, 9) AS score, user_bucket"

FALLBACK_SHOWN = """fallback_type, genre, rank, item_id, title, genres, rating_count,
    round(avg_rating, 9) AS avg_rating, round(popularity_score, 9) AS popularity_score"""

# Evaluation: recommendations built from train for the users of test, judged against test.
EVALUATION: dict[str, str] = {
    "eval_candidates": "SELECT * FROM candidates WHERE user_id IN (SELECT user_id FROM test)",
    **hybrid("train", "eval_candidates", 10),
    "relevant": "SELECT DISTINCT user_id, item_id FROM test WHERE rating >= 4.0e0",
    "relevant_counts": "SELECT user_id, count(*) AS relevant_count FROM relevant GROUP BY user_id",
    "judged": """
        SELECT b.user_id, b.item_id, b.rank, row_number() OVER (PARTITION BY b.user_id ORDER BY b.rank, b.item_id) - 1 AS pos,
               CASE WHEN r.item_id IS NULL THEN 0 ELSE 1 END AS hit
        FROM best b LEFT JOIN relevant r ON r.user_id = b.user_id AND r.item_id = b.item_id""",
    "gains": """SELECT user_id, count(DISTINCT item_id) FILTER (hit = 1) AS hit_count,
                       sum(hit / log2(pos + 2e0)) AS dcg FROM judged GROUP BY user_id""",
    "ideal": """
        SELECT user_id, relevant_count, (SELECT sum(1e0 / log2(i + 2e0)) FROM range(0, 10) t(i)
                                         WHERE i < relevant_count) AS idcg FROM relevant_counts""",
    "metrics": """
        SELECT CAST(10 AS BIGINT) AS k, 4.0e0 AS relevant_threshold, round(avg(hit_count / 10e0), 9) AS precision_at_k,
               round(avg(CAST(hit_count AS DOUBLE) / relevant_count), 9) AS recall_at_k,
               round(avg(dcg / idcg), 9) AS ndcg_at_k, count(*) AS evaluated_users
        FROM gains JOIN ideal USING (user_id)""",
}

# Serving: requests answered from the precomputed rows and the fallback lists.
PRECOMPUTED = hybrid("ratings", "candidates", 50)


def serving(requests: str) -> dict[str, str]:
    return {
        **PRECOMPUTED,
        **fallback("ratings", 20),
        "asked": f"""
            SELECT request_id, user_id, CAST(coalesce(nullif(top_n, 0), 10) AS INT) AS top_n, nullif(genre, '') AS genre
            FROM {requests}""",
        "hybrid_rows": """
            SELECT * FROM (SELECT q.request_id, q.top_n, r.*,
                     row_number() OVER (PARTITION BY q.request_id ORDER BY r.rank) - 1 AS pos
              FROM asked q JOIN recs r ON r.user_id = q.user_id
              WHERE q.genre IS NULL OR contains(lower(r.genres), lower(q.genre))) WHERE pos < top_n""",
        "routed": """
            SELECT q.*, q.user_id IN (SELECT user_id FROM merged) AS has_history,
                   CASE WHEN q.user_id IN (SELECT user_id FROM merged)
                             AND q.request_id IN (SELECT request_id FROM hybrid_rows)
                        THEN 'hybrid' ELSE 'fallback' END AS route
            FROM asked q""",
        "genre_list": """
            SELECT lower(genre) AS genre_key, item_id, title, genres, popularity_score,
                   row_number() OVER (PARTITION BY lower(genre) ORDER BY rank, item_id) - 1 AS pos FROM fb_genre""",
        "global_list": "SELECT item_id, title, genres, popularity_score, rank - 1 AS pos FROM fb_global",
        "fallback_rows": """
            SELECT r.request_id, l.pos, l.item_id, l.title, l.genres, l.popularity_score,
                   'Matches requested genre: ' || r.genre AS "explain"
            FROM routed r JOIN genre_list l ON l.genre_key = lower(r.genre) AND l.pos < r.top_n WHERE r.route = 'fallback'
            UNION ALL
            SELECT r.request_id, l.pos, l.item_id, l.title, l.genres, l.popularity_score,
                   'Top trending fallback recommendation.'
            FROM routed r JOIN global_list l ON l.pos < r.top_n
            WHERE r.route = 'fallback' AND (r.genre IS NULL OR lower(r.genre) NOT IN (SELECT genre_key FROM genre_list))""",
        "rec_rows": """
            SELECT h.request_id, h.pos, h.item_id, h.title, h.genres, h.score, h.als_score, h.content_score, h.rank,
                   h."explain"
            FROM hybrid_rows h JOIN routed r ON r.request_id = h.request_id AND r.route = 'hybrid'
            UNION ALL
            SELECT request_id, pos, item_id, title, genres, popularity_score, NULL, NULL, NULL, "explain" FROM fallback_rows""",
        "selected": """
            SELECT r.request_id, r.route, r.top_n,
                   coalesce(r.genre, nullif(trim(string_split(f.genres, '|')[1]), '')) AS selected_genre
            FROM routed r LEFT JOIN rec_rows f ON f.request_id = r.request_id AND f.pos = 0""",
    }


SERVING = serving("requests_raw")


def oracle(name: str, final: str, *extra: dict[str, str]) -> None:
    """Register ``final`` with the domain views and the given further views in front."""
    views = dict(VIEWS)
    for more in extra:
        views.update(more)
    ORACLES[name] = "WITH " + ",\n".join(f"{view} AS ({sql})" for view, sql in views.items()) + "\n" + final


RATING_COLUMNS = "user_id, item_id, rating, ts"
BUCKET = "CAST(user_id % 64 AS INT) AS user_bucket"

oracle("read_ratings", f"SELECT {RATING_COLUMNS} FROM ratings_raw")
oracle("read_items", "SELECT * FROM items_raw")
oracle("read_feedback", "SELECT * FROM feedback")
oracle(
    "header_auto",
    "SELECT *, 'yes' AS header FROM feedback UNION ALL SELECT *, 'no' FROM feedback",
)
oracle("write_silver_ratings", f"SELECT {RATING_COLUMNS}, {BUCKET} FROM ratings")
oracle(
    "read_silver_ratings",
    f"SELECT {RATING_COLUMNS}, {BUCKET} FROM ratings WHERE user_id IN (SELECT user_id FROM requests_raw)",
)
oracle("write_silver_items", "SELECT * FROM items")
oracle("read_silver_items", "SELECT * FROM items")
for key in ("write_gold_fallback", "read_gold_fallback"):
    oracle(key, f"SELECT {FALLBACK_SHOWN.replace('rank,', 'CAST(rank AS INT) AS rank,')} FROM fb_all", fallback("ratings", 20))
oracle("write_gold_precomputed", f"SELECT {PRECOMPUTED_SHOWN} FROM recs", PRECOMPUTED)
oracle(
    "read_gold_precomputed",
    """SELECT user_id, item_id, CAST(rank AS INT) AS rank, round(score, 9) AS score, user_bucket FROM recs
       WHERE user_id IN (SELECT user_id FROM requests_raw)""",
    PRECOMPUTED,
)

oracle("clean_ratings", f"SELECT {RATING_COLUMNS}, {BUCKET} FROM ratings")
oracle("clean_items", "SELECT * FROM items")
oracle(
    "clean_stats",
    """SELECT 'ratings' AS table_name, (SELECT count(*) FROM ratings_raw) AS rows_before,
              (SELECT count(*) FROM ratings) AS rows_after,
              (SELECT count(*) FROM ratings_raw) - (SELECT count(*) FROM ratings) AS rows_dropped
       UNION ALL
       SELECT 'items', (SELECT count(*) FROM items_raw), (SELECT count(*) FROM items),
              (SELECT count(*) FROM items_raw) - (SELECT count(*) FROM items)""",
)
oracle("user_bucket", f"SELECT DISTINCT user_id, {BUCKET} FROM ratings")
oracle("merge_feedback", f"SELECT {RATING_COLUMNS} FROM merged")
oracle(
    "rating_gate",
    "SELECT *, coalesce(rating BETWEEN 0.5e0 AND 5.0e0, false) AS accepted FROM feedback",
)
oracle(
    "event_gate",
    """SELECT event_id, "timestamp", event_type, user_id, item_id,
              event_type IN ('click', 'view', 'rate', 'skip') AS accepted FROM behaviour""",
)
oracle(
    "rating_to_event",
    """SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS "timestamp", 'rate' AS event_type, user_id,
              item_id, rating FROM feedback WHERE rating BETWEEN 0.5e0 AND 5.0e0""",
)

oracle(
    "genre_array",
    """SELECT item_id, array_to_string(list_filter(l, lambda g: trim(g) <> ''), '+') AS genres_kept,
              CAST(len(list_filter(l, lambda g: trim(g) <> '')) AS BIGINT) AS kept_count,
              array_to_string(l, '+') AS genres_all, CAST(len(l) AS BIGINT) AS all_count
       FROM (SELECT item_id, string_split(genres, '|') AS l FROM items)""",
)
oracle("explode_genres", "SELECT item_id, genre FROM item_genres WHERE length(trim(genre)) > 0")
oracle("explode_genres_blank", "SELECT item_id, genre FROM item_genres")
oracle("item_features", "SELECT * FROM features")
oracle(
    "title_without_year",
    "SELECT item_id, regexp_replace(title, '\\s*\\(\\d{4}\\)\\s*$', '') AS short_title FROM items",
)
oracle("genre_contains", "SELECT * FROM items WHERE contains(lower(genres), 'red')")
oracle(
    "genre_equals", f"SELECT {FALLBACK_SHOWN} FROM fb_genre WHERE lower(genre) = 'economy'", fallback("ratings", 10)
)
oracle(
    "ratings_x_genres",
    "SELECT item_id, user_id, rating, ts, genre FROM genre_rows",
    tastes("ratings"),
)

STATS_SHOWN = "round(avg_rating, 9) AS avg_rating, round(popularity_score, 9) AS popularity_score"
oracle(
    "item_popularity",
    f"SELECT item_id, rating_count, {STATS_SHOWN}, round(popularity_norm, 9) AS popularity_norm FROM pop",
    popular("ratings"),
)
oracle("item_stats_min_count", f"SELECT item_id, rating_count, {STATS_SHOWN} FROM fb_stats", fallback("ratings", 10))
oracle(
    "genre_item_stats",
    f"SELECT genre, item_id, title, genres, rating_count, {STATS_SHOWN} FROM fb_genre_stats",
    fallback("ratings", 10),
)
oracle("fallback_global", f"SELECT {FALLBACK_SHOWN} FROM fb_global", fallback("ratings", 10))
oracle("fallback_by_genre", f"SELECT {FALLBACK_SHOWN} FROM fb_genre", fallback("ratings", 10))
oracle("fallback_all", f"SELECT {FALLBACK_SHOWN} FROM fb_all", fallback("ratings", 10))
oracle("published_fallback", f"SELECT {FALLBACK_SHOWN} FROM fb_all", fallback("ratings", 10))
oracle(
    "top_trending",
    """SELECT rank, item_id, title, genres, round(popularity_score, 9) AS popularity_score,
              'Top trending by global popularity.' AS "explain" FROM fb_global WHERE rank <= 10""",
    fallback("ratings", 20),
)
oracle(
    "top_by_genre",
    """SELECT w.genre, rank, item_id, title, genres, round(popularity_score, 9) AS popularity_score,
              'Popular in genre: ' || w.genre AS "explain"
       FROM (SELECT DISTINCT genre FROM requests_raw WHERE genre IS NOT NULL) w
       JOIN fb_genre f ON lower(f.genre) = lower(w.genre) WHERE rank <= 10""",
    fallback("ratings", 20),
)

oracle(
    "user_genre_profile",
    """SELECT user_id, genre, genre_interactions, round(genre_avg_rating, 9) AS genre_avg_rating,
              round(genre_weight, 9) AS genre_weight, favorite_rank FROM profile""",
    tastes("ratings"),
)
oracle(
    "favorite_genre",
    """SELECT user_id, genre AS favorite_genre, round(genre_weight, 9) AS favorite_genre_weight FROM profile
       WHERE favorite_rank = 1""",
    tastes("ratings"),
)
oracle(
    "anchor_items",
    "SELECT anchor_item_id, user_id, genre, anchor_rating, anchor_title FROM anchors",
    tastes("ratings"),
)
oracle("seen_pairs", "SELECT DISTINCT user_id, item_id FROM ratings")
oracle("drop_seen", "SELECT user_id, item_id, als_score FROM fresh", hybrid())
CONTENT_SHOWN = """user_id, item_id, als_score, round(content_score, 9) AS content_score"""
oracle(
    "content_score",
    f"""SELECT {CONTENT_SHOWN}, round(max_genre_weight, 9) AS max_genre_weight,
               CAST(genre_match_count AS BIGINT) AS genre_match_count FROM content""",
    tastes("ratings"),
    contents("candidates"),
)

oracle("als_norm", f"SELECT user_id, item_id, als_score, round({NORM}, 9) AS als_norm FROM candidates")
oracle(
    "hybrid_score",
    f"""SELECT {CONTENT_SHOWN}, round({NORM}, 9) AS als_norm,
               round(0.7e0 * {NORM} + 0.3e0 * content_score, 9) AS hybrid_score FROM content""",
    tastes("ratings"),
    contents("candidates"),
)
oracle(
    "recency_norm",
    """SELECT item_id, title, release_year,
              round(CASE WHEN release_year IS NOT NULL AND max(release_year) OVER () > min(release_year) OVER ()
                         THEN CAST(release_year - min(release_year) OVER () AS DOUBLE)
                              / (max(release_year) OVER () - min(release_year) OVER ()) ELSE 0e0 END, 9) AS recency_norm
       FROM features""",
)
oracle(
    "hybrid_rerank",
    """SELECT user_id, item_id, primary_genre, release_year, round(als_norm, 9) AS als_norm,
              round(hybrid_score, 9) AS hybrid_score, round(popularity_norm, 9) AS popularity_norm,
              round(recency_norm, 9) AS recency_norm, genre_rank, round(rerank_score, 9) AS rerank_score, rank FROM best""",
    hybrid(),
)
oracle("final_rank", "SELECT user_id, item_id, rank FROM best", hybrid())
oracle("hybrid_from_candidates", f"SELECT {HYBRID_SHOWN} FROM recs", hybrid())
oracle(
    "explain",
    'SELECT user_id, item_id, anchor_title, explain_because, explain_social, explain_genre, "explain" FROM recs',
    hybrid(),
)
oracle("hybrid_precomputed", f"SELECT {PRECOMPUTED_SHOWN} FROM recs", PRECOMPUTED)

oracle("train_test_split", f"SELECT {RATING_COLUMNS}, is_test FROM split_ratings")
oracle("eval_users", "SELECT DISTINCT user_id FROM test")
oracle("relevant_items", "SELECT user_id, item_id FROM relevant", EVALUATION)
oracle(
    "recommended_list",
    """SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos) AS item_ids FROM judged GROUP BY user_id""",
    EVALUATION,
)
oracle("top_k_slice", "SELECT user_id, item_id, rank, pos AS position FROM judged WHERE rank <= 5", EVALUATION)
oracle("hits_per_user", "SELECT user_id, hit_count FROM gains", EVALUATION)
oracle("dcg_per_user", "SELECT user_id, round(dcg, 9) AS dcg FROM gains", EVALUATION)
oracle("idcg", "SELECT user_id, relevant_count, round(idcg, 9) AS idcg FROM ideal", EVALUATION)
oracle("ranking_metrics", "SELECT * FROM metrics", EVALUATION)
oracle("hybrid_ranking_eval", "SELECT * FROM metrics", EVALUATION)
oracle(
    "append_ranking_metrics",
    "SELECT 'hybrid_rerank' AS algorithm, * FROM metrics",
    EVALUATION,
)
oracle(
    "rmse",
    f"""SELECT round(sqrt(avg((rating - avg_rating) * (rating - avg_rating))), 9) AS rmse
        FROM test JOIN ({stats('train')}) USING (item_id)""",
)
TRIALS = {
    "trial_rows": """
        SELECT 'run-1' AS run_id, l_linenumber * 10 + flag AS trial_no, l_linenumber * 4 AS rank, CAST(flag AS DOUBLE) / 4 AS reg_param,
               10 AS max_iter, round(sqrt(avg((l_quantity - 25) * (l_quantity - 25))), 9) AS rmse
        FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS flag FROM lineitem)
        GROUP BY l_linenumber, flag"""
}
oracle(
    "best_trial",
    """SELECT rmse AS best_rmse, rank, reg_param, max_iter, (SELECT count(*) FROM trial_rows) AS trial_count
       FROM trial_rows ORDER BY rmse, trial_no LIMIT 1""",
    TRIALS,
)
oracle("append_trials", "SELECT * FROM trial_rows", TRIALS)
oracle(
    "latest_metrics",
    """SELECT ts AS timestamp_utc, 'hybrid_rerank' AS algorithm,
              round(avg(CASE WHEN rating >= 4.0e0 THEN 1e0 ELSE 0e0 END), 9) AS precision_at_k, count(*) AS evaluated_users
       FROM ratings GROUP BY ts ORDER BY ts DESC LIMIT 1""",
)

KEY_TEXT = """'user=' || CAST(user_id AS VARCHAR) || ':top=' || CAST(top_n AS VARCHAR) || ':genre='
    || coalesce(nullif(lower(trim(genre)), ''), 'all')"""
oracle("request_key", f"SELECT *, {KEY_TEXT} AS request_key FROM asked", SERVING)
oracle(
    "distinct_requests",
    f"SELECT {KEY_TEXT} AS request_key, count(*) AS requests FROM profile_requests GROUP BY ALL",
)
oracle(
    "user_has_history",
    "SELECT request_id, user_id, user_id IN (SELECT user_id FROM merged) AS has_history FROM requests_raw",
)
REC_SHOWN = """item_id, title, genres, round(score, 9) AS score, als_score, round(content_score, 9) AS content_score,
    rank, "explain" """
oracle("normalize_recs", f"SELECT user_id, {REC_SHOWN} FROM recs", PRECOMPUTED)
oracle("serve_hybrid", f"SELECT request_id, pos, {REC_SHOWN} FROM hybrid_rows", SERVING)
oracle("route_requests", "SELECT request_id, user_id, top_n, genre, has_history, route FROM routed", SERVING)
oracle(
    "serve_fallback",
    """SELECT request_id, pos, item_id, title, genres, round(popularity_score, 9) AS score, CAST(NULL AS DOUBLE) AS als_score,
              CAST(NULL AS DOUBLE) AS content_score, "explain" FROM fallback_rows""",
    SERVING,
)
oracle(
    "serve_batch",
    """SELECT s.request_id, s.route, s.selected_genre, x.section, x.pos, x.item_id, x.title, round(x.score, 9) AS score,
              x."explain"
       FROM selected s JOIN (
         SELECT request_id, 'recommendations' AS section, pos, item_id, title, score, "explain" FROM rec_rows
         UNION ALL
         SELECT q.request_id, 'top_trending', pos, item_id, title, popularity_score, 'Top trending by global popularity.'
         FROM asked q JOIN global_list l ON l.pos < least(10, greatest(3, q.top_n))
         UNION ALL
         SELECT q.request_id, 'top_by_genre', pos, item_id, title, popularity_score,
                'Popular in genre: ' || q.selected_genre
         FROM selected q JOIN genre_list l
           ON l.genre_key = lower(q.selected_genre) AND l.pos < least(10, greatest(3, q.top_n))) x
       ON x.request_id = s.request_id""",
    SERVING,
)
oracle(
    "because_you_watched",
    'SELECT request_id, pos, item_id, title, "explain" FROM rec_rows WHERE pos < 5',
    SERVING,
)
oracle(
    "serve_distinct",
    'SELECT request_id, pos, item_id, title, "explain" FROM rec_rows WHERE pos < 5',
    serving("profile_requests"),
)
oracle(
    "score_rows",
    """SELECT request_id, pos, item_id, round(score, 9) AS score, als_score, round(content_score, 9) AS content_score
       FROM rec_rows""",
    SERVING,
)
oracle("selected_genre", "SELECT request_id, route, selected_genre FROM selected", SERVING)

oracle("profile_defaults", "SELECT * FROM profiles")
oracle("active_profiles", "SELECT * EXCLUDE (status) FROM profiles_raw WHERE status = 'hoat_dong'")
oracle("route_profiles", "SELECT * REPLACE (CAST(top_n AS BIGINT) AS top_n) FROM profile_requests")
oracle(
    "latest_profile_rating",
    """SELECT profile_id, item_id, rating, source, rated_at FROM (
         SELECT user_id AS profile_id, item_id, rating, 'ui' AS source, ts AS rated_at,
                row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, src_order DESC, rating DESC) AS rn
         FROM ratings_raw WHERE rating BETWEEN 0.5e0 AND 5.0e0) WHERE rn = 1""",
)
ORACLES["stream_profile_ratings"] = ORACLES["latest_profile_rating"]
oracle(
    "ensure_item_stub",
    """SELECT * FROM items UNION ALL
       SELECT DISTINCT item_id, 'Unknown', CAST(NULL AS VARCHAR) FROM candidates
       WHERE item_id NOT IN (SELECT item_id FROM items)""",
)
oracle(
    "recommendation_history",
    """SELECT r.request_id, p.profile_id, r.route, CAST(r.top_n AS BIGINT) AS top_n, r.genre
       FROM routed r JOIN profile_requests p ON p.request_id = r.request_id""",
    serving("profile_requests"),
)
oracle(
    "history_last_n",
    """SELECT history_id, profile_id, route, CAST(10 AS BIGINT) AS top_n, created_at, place FROM (
         SELECT o_orderkey AS history_id, o_custkey AS profile_id,
                CASE o_orderstatus WHEN 'O' THEN 'hybrid' WHEN 'F' THEN 'fallback' ELSE 'als_legacy' END AS route,
                strftime(o_orderdate, '%Y-%m-%d') AS created_at,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders) WHERE place <= 5""",
)
oracle(
    "stored_history",
    """SELECT * FROM (
         SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY history_id DESC) AS place FROM (
           SELECT row_number() OVER (ORDER BY r.request_id % 2, r.request_id) AS history_id, r.request_id, p.profile_id, r.route,
                  CAST(r.top_n AS BIGINT) AS top_n, r.genre
           FROM routed r JOIN profile_requests p ON p.request_id = r.request_id)) WHERE place <= 5""",
    serving("profile_requests"),
)
ORACLES["profile_rating_store"] = ORACLES["latest_profile_rating"]
oracle(
    "ingest_feedback",
    """SELECT 'ratings' AS output, user_id, item_id, max(rating) AS rating, ts FROM feedback
       WHERE rating BETWEEN 0.5e0 AND 5.0e0 GROUP BY user_id, item_id, ts
       UNION ALL
       SELECT DISTINCT 'rejected', user_id, item_id, rating, ts FROM feedback WHERE NOT coalesce(rating BETWEEN 0.5e0 AND 5.0e0, false)
       UNION ALL
       SELECT DISTINCT 'rate', user_id, item_id, rating, ts FROM feedback WHERE rating BETWEEN 0.5e0 AND 5.0e0""",
)
oracle(
    "stream_event_sink",
    """SELECT "timestamp", event_type, user_id, item_id, k, substr("timestamp", 1, 10) AS dt,
              event_type IN ('click', 'view', 'rate', 'skip') AS accepted FROM behaviour""",
)
ORACLES["ingest_events"] = ORACLES["stream_event_sink"]
oracle(
    "stream_feedback_sink",
    """SELECT user_id, item_id, max(rating) AS rating, ts, true AS accepted FROM feedback
       WHERE rating BETWEEN 0.5e0 AND 5.0e0 GROUP BY user_id, item_id, ts
       UNION ALL
       SELECT user_id, item_id, rating, ts, false FROM feedback WHERE NOT coalesce(rating BETWEEN 0.5e0 AND 5.0e0, false)""",
)
# What is certain of a fitted model, whose factors differ from one partitioning to the next.
oracle(
    "als_fit",
    """SELECT DISTINCT 'user' AS kind, user_id AS id, CAST(20 AS BIGINT) AS factors, true AS nonnegative FROM train
       UNION ALL SELECT DISTINCT 'item', item_id, 20, true FROM train""",
)
oracle(
    "load_als_model",
    """SELECT DISTINCT 'user' AS kind, user_id AS id, CAST(20 AS BIGINT) AS factors FROM train
       UNION ALL SELECT DISTINCT 'item', item_id, 20 FROM train""",
)
oracle(
    "als_predict",
    """SELECT user_id, item_id, rating, true AS sound FROM test
       WHERE user_id IN (SELECT user_id FROM train) AND item_id IN (SELECT item_id FROM train)""",
)
_PER_USER = """SELECT DISTINCT user_id, least(50, (SELECT count(DISTINCT item_id) FROM train)) AS candidates,
                      least(50, (SELECT count(DISTINCT item_id) FROM train)) AS items, 0::BIGINT AS without_score FROM train"""
oracle("als_candidates_all", _PER_USER)
oracle("als_candidates_subset", _PER_USER + " WHERE user_id IN (SELECT user_id FROM test)")
oracle("als_top_k", "SELECT user_id, candidates, true AS same_scores, true AS no_more_pairs FROM (" + _PER_USER + ")")
oracle(
    "als_enriched",
    """SELECT DISTINCT user_id, least(50, (SELECT count(DISTINCT item_id) FROM train)) AS candidates, 0::BIGINT AS different
       FROM train""",
)
oracle(
    "serve_als_legacy",
    """SELECT r.request_id, r.user_id,
              CASE WHEN r.route = 'hybrid' THEN 'hybrid' WHEN r.has_history AND m.user_id IS NOT NULL THEN 'als_legacy'
                   ELSE 'fallback' END AS route,
              CASE WHEN r.route <> 'hybrid' AND r.has_history AND m.user_id IS NOT NULL
                     THEN least(r.top_n, 20, (SELECT count(DISTINCT item_id) FROM train))
                   ELSE coalesce(n.recommended, 0) END AS recommended
       FROM routed r LEFT JOIN (SELECT DISTINCT user_id FROM train) m USING (user_id)
       LEFT JOIN (SELECT request_id, count(*) AS recommended FROM rec_rows GROUP BY request_id) n USING (request_id)""",
    SERVING,
)
oracle(
    "als_grid",
    """SELECT CAST(row_number() OVER (ORDER BY rank, reg_param, max_iter) AS INT) AS trial_no, rank, reg_param, max_iter,
              true AS sound, true AS best_is_lowest
       FROM (VALUES (16), (32)) a (rank), (VALUES (0.05e0), (0.1e0)) b (reg_param), (VALUES (10), (15)) c (max_iter)""",
)
oracle(
    "save_model_version",
    "SELECT true AS named, true AS newest, true AS distinct_paths, count(DISTINCT user_id) AS users FROM train",
)
oracle("hybrid_precomputed_als", "SELECT 0::BIGINT AS gaps, 0::BIGINT AS outside, 0::BIGINT AS seen")
oracle("hybrid_ranking_eval_als", "SELECT 10::BIGINT AS k, true AS precision_at_k, true AS recall_at_k, true AS ndcg_at_k")
oracle(
    "retrain_job",
    """SELECT fallback_type, genre, CAST(rank AS BIGINT) AS rank, CAST(item_id AS BIGINT) AS value FROM fb_all
       UNION ALL SELECT 'trials', NULL, 0, 8 UNION ALL SELECT 'metrics', NULL, 0, 1
       UNION ALL SELECT 'models', NULL, 0, 1 UNION ALL SELECT 'violations', NULL, 0, 0""",
    fallback("merged", 50),
)
