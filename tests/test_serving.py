import pytest
from pyspark.sql import functions as F

from tastegrid import ServeConfig
from tastegrid.operators import profiles, serving
from tests.helpers import by, tuples

FALLBACK = (
    "fallback_type string, genre string, rank int, item_id int, title string, genres string, rating_count long, "
    "avg_rating double, popularity_score double"
)
STORED = (
    "user_id int, item_id int, title string, genres string, score double, als_score double, content_score double, "
    "rank int, explain string"
)


@pytest.fixture
def stores(rows, ratings):
    known = ratings((1, 1, 3.0, 1), (1, 2, 3.0, 1), (2, 1, 3.0, 1))
    stored = rows(
        STORED,
        *[(1, 10 + n, f"T{n}", "Drama|War" if n % 2 else "Comedy", 1.0 - n / 10, 4.0, 0.5, n + 1, None) for n in range(6)],
        (3, 99, "T", "Drama", 1.0, 4.0, 0.5, 1, "x"),
    )
    fallback = rows(
        FALLBACK,
        *[("global", None, n, 100 + n, f"G{n}", "Action|War", 9, 3.0, 9.0 - n) for n in range(1, 13)],
        *[("genre", "Drama", n, 200 + n, f"D{n}", "Drama", 9, 3.0, 5.0 - n) for n in range(1, 5)],
        ("genre", "Action", 1, 300, "A", "Action", 9, 3.0, 1.0),
    )
    return known, stored, fallback


def answers(rows, stores, *requests, **kwargs):
    asked = rows("request_id long, user_id int, top_n int, genre string", *requests)
    known, stored, fallback = stores
    return by(serving.serve_batch(asked, known, stored, fallback, **kwargs), "request_id")


def items_of(answer, section="recommendations"):
    return [rec["item_id"] for rec in answer[section]]


def test_hybrid_route(rows, stores):
    got = answers(rows, stores, (1, 1, 3, None), (2, 1, 3, "drama"), (3, 1, None, ""), (4, 1, 0, None))
    assert got[1]["route"] == "hybrid" and items_of(got[1]) == [10, 11, 12]
    # Stored ranks stay, so they have gaps after the genre filter.
    assert items_of(got[2]) == [11, 13, 15] and [r["rank"] for r in got[2]["recommendations"]] == [2, 4, 6]
    assert got[3]["top_n"] == 10 and items_of(got[3]) == [10, 11, 12, 13, 14, 15] and got[4]["top_n"] == 10
    assert got[1]["recommendations"][0]["explain"] == ""
    assert got[1]["selected_genre"] == "Comedy" and got[1]["top_by_genre"] == []
    assert len(got[3]["because_you_watched"]) == 5 and set(got[3]["scores"][0]) == {
        "item_id", "score", "als_score", "content_score",
    }


def test_fallback_routes(rows, stores):
    got = answers(
        rows,
        stores,
        (1, 555, 2, None),
        (2, 555, 2, "DRAMA"),
        (3, 555, 2, "no-such"),
        (4, 1, 20, "no-such"),
        (5, 2, 1, None),
        (6, 3, 1, None),
    )
    assert {answer["route"] for answer in got.values()} == {"fallback"}
    assert items_of(got[1]) == [101, 102]
    first = got[1]["recommendations"][0]
    assert first["explain"] == "Top trending fallback recommendation." and first["score"] == 8.0
    assert (first["als_score"], first["content_score"], first["rank"]) == (None, None, None)
    assert items_of(got[2]) == [201, 202]
    assert got[2]["recommendations"][0]["explain"] == "Matches requested genre: DRAMA"
    assert items_of(got[3]) == [101, 102] and items_of(got[4]) == list(range(101, 113))
    # 2 has history but nothing stored; 3 has stored rows but no history.
    assert items_of(got[5]) == [101] and items_of(got[6]) == [101]


def test_side_lists(rows, stores):
    got = answers(rows, stores, (1, 555, 1, None), (2, 555, 50, "Drama"), (3, 555, 5, "no-such"))
    # Never fewer than 3 nor more than 10.
    assert items_of(got[1], "top_trending") == [101, 102, 103] and len(got[2]["top_trending"]) == 10
    assert got[1]["top_trending"][0]["explain"] == "Top trending by global popularity."
    assert got[1]["selected_genre"] == "Action" and items_of(got[1], "top_by_genre") == [300]
    assert got[2]["top_by_genre"][0]["explain"] == "Popular in genre: Drama"
    assert items_of(got[2], "top_by_genre") == [201, 202, 203, 204] and got[3]["top_by_genre"] == []


def test_direct_model_route(rows, stores):
    direct = rows(
        "user_id int, item_id int, als_score double, title string, genres string",
        (2, 1, 3.0, "a", "Drama"), (2, 2, 4.0, "b", "Drama"), (555, 1, 3.0, "a", "Drama"),
    )
    allowed = ServeConfig(allow_als_legacy=True)
    asked = ((1, 2, 5, None), (2, 555, 5, None), (3, 1, 5, None), (4, 1, 5, "none"))
    got = answers(rows, stores, *asked, als_recommendations=direct, config=allowed)
    assert got[1]["route"] == "als_legacy" and items_of(got[1]) == [2, 1]
    rec = got[1]["recommendations"][0]
    assert (rec["score"], rec["als_score"], rec["content_score"], rec["rank"]) == (4.0, 4.0, 0.0, None)
    assert rec["explain"] == "Users similar to you liked this."
    assert [got[n]["route"] for n in (2, 3, 4)] == ["fallback", "hybrid", "fallback"]
    off = answers(rows, stores, *asked, als_recommendations=direct)
    assert off[1]["route"] == "fallback"


def test_empty_fallback_still_answers(rows, stores):
    known, stored, fallback = stores
    got = answers(rows, (known, stored, fallback.filter("false")), (1, 555, 5, None), (2, 1, 2, None))
    assert got[1]["route"] == "fallback" and got[1]["recommendations"] == [] and got[1]["top_trending"] == []
    assert items_of(got[2]) == [10, 11]


def test_distinct_requests(rows):
    asked = rows("user_id int, top_n int, genre string", (1, 5, "A"), (1, 5, " a"), (1, 5, None))
    assert tuples(serving.distinct_requests(asked)) == [("user=1:top=5:genre=a", 2), ("user=1:top=5:genre=all", 1)]


def test_profile_defaults(rows):
    raw = rows(
        "profile_id long, account_id int, profile_name string, mode string, user_id int",
        (1, 5, " A ", "ca_nhan_hoa", None), (2, 5, "B", "other", None), (3, 5, "C", None, 77),
    )
    assert tuples(profiles.profile_defaults(raw), "profile_name", "mode", "user_id") == [
        ("A", "ca_nhan_hoa", 2),
        ("B", "so_thich_ban_dau", 900005),
        ("C", "so_thich_ban_dau", 77),
    ]


def test_route_profiles(rows):
    owned = rows("profile_id long, account_id int, user_id int, preferred_genre string", (1, 5, 77, "War"), (2, 5, 78, None))
    asked = rows(
        "request_id long, profile_id long, account_id int, top_n int, genre string",
        (1, 1, 5, 10, None), (2, 1, 5, 10, "Drama"), (3, 1, 6, 10, None), (4, 2, 5, 10, ""),
    )
    assert tuples(profiles.route_profiles(asked, owned), "request_id", "user_id", "genre") == [
        (1, 77, "War"),
        (2, 77, "Drama"),
        (4, 78, None),
    ]


def test_last_write_wins(rows):
    writes = rows(
        "profile_id long, item_id int, rating double, source string, rated_at long, write_no long",
        (1, 1, 3.0, "ui", 5, 1), (1, 1, 2.0, "ui", 6, 1), (1, 1, 4.0, "ui", 6, 2), (1, 2, 1.0, "ui", 1, 1),
    )
    assert tuples(profiles.latest_profile_rating(writes)) == [(1, 1, 4.0, "ui", 6), (1, 2, 1.0, "ui", 1)]


def test_item_stubs(items, rows):
    stubs = profiles.ensure_item_stub(items((1, "A", "x")), rows("item_id int", (1,), (2,), (2,)))
    assert tuples(stubs) == [(1, "A", "x"), (2, "Unknown", None)]


@pytest.mark.parametrize("n,kept", [(2, 2), (120, 120), (500, 150)])
def test_history_size(rows, n, kept):
    history = rows("history_id long, profile_id long", *[(i, 1) for i in range(150)])
    got = tuples(profiles.history_last_n(history, n), "history_id")
    assert len(got) == kept and (149,) in got
    with pytest.raises(ValueError):
        profiles.history_last_n(history, 0)


def test_short_answers_are_marked(rows, stores):
    got = answers(rows, stores, (1, 555, 12, None), (2, 555, 13, None), (3, 1, 6, None), (4, 1, 7, None))
    assert [got[n]["short"] for n in (1, 2, 3, 4)] == [False, True, False, True]


def test_equal_requests_are_answered_once(rows, stores):
    hot = [(i, 1, 3, None) for i in range(40)]
    others = [(100, 1, 3, "drama"), (101, 1, 3, ""), (102, None, None, None), (103, None, 10, ""), (104, 2, 0, "Drama"), (105, 9, 10, "Drama"), (105, 9, 10, "Drama"), (None, 9, 10, "drama")]
    asked = rows("request_id long, user_id int, top_n int, genre string", *hot, *others)
    plain = tuples(serving.serve_batch(asked, *stores))
    for copies in (7, 100):
        assert tuples(serving.serve_distinct(asked, *stores, copy_requests=copies)) == plain
    assert serving.serve_distinct(asked.limit(0), *stores).collect() == []


def test_answering_takes_as_many_rows_as_there_are_keys(spark, rows, stores):
    asked = rows("request_id long, user_id int, top_n int, genre string", *[(i, 1 if i % 3 == 0 else i, 3, None) for i in range(300)])
    seen = []
    real = serving.serve_batch

    def counted(requests, *args, **kwargs):
        seen.append(requests.count())
        return real(requests, *args, **kwargs)

    serving.serve_batch = counted
    try:
        answered = serving.serve_distinct(asked, *stores, copy_requests=20)
    finally:
        serving.serve_batch = real
    assert seen == [asked.select("user_id").distinct().count()]
    # The hot key's requests, a third of all, are dealt over its copies.
    dealt = [r["count"] for r in answered.filter("user_id = 1").groupBy(F.pmod(F.xxhash64("request_id"), F.lit(5))).count().collect()]
    assert len(dealt) == 5 and max(dealt) < 60 and answered.count() == 300
