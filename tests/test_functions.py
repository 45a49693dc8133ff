import math

import pytest
from pyspark.sql import functions as F

from tastegrid import functions as tg
from tests.helpers import tuples


def test_genre_array_keeps_or_drops_blanks(rows):
    df = rows("g string", ("A||B",), ("",), (None,), ("A| |C",))
    kept = [r[0] for r in df.select(tg.genre_array("g")).collect()]
    every = [r[0] for r in df.select(tg.genre_array("g", keep_blank=True)).collect()]
    assert kept == [["A", "B"], [], None, ["A", "C"]]
    assert every == [["A", "", "B"], [""], None, ["A", " ", "C"]]


def test_primary_genre_may_be_blank(rows):
    df = rows("g string", ("A|B",), ("|B",), (None,), ("(no genres listed)",))
    assert [r[0] for r in df.select(tg.primary_genre("g")).collect()] == ["A", "", None, "(no genres listed)"]


def test_genre_matching(rows):
    df = rows("g string, w string", ("Drama|Action", "drama"), ("Drama", "Drama|Action"), (None, "x"))
    assert [tuple(r) for r in df.select(tg.matches_genre("g", "w"), tg.same_genre("g", "w")).collect()] == [
        (True, False),
        (False, False),
        (None, None),
    ]


@pytest.mark.parametrize(
    "title,year,short",
    [
        ("Heat (1995)", 1995, "Heat"),
        ("Heat (1995)  ", 1995, "Heat"),
        ("Heat", None, "Heat"),
        ("1984 (1984) remade", None, "1984 (1984) remade"),
        ("", None, ""),
        (None, None, None),
    ],
)
def test_titles(rows, title, year, short):
    row = rows("title string", (title,)).select(tg.release_year(), tg.title_without_year()).head()
    assert tuple(row) == (year, short)


def test_user_bucket_of_negative_ids(rows):
    df = rows("user_id int", (-3,), (0,), (64,), (65,))
    assert [r[0] for r in df.select(tg.user_bucket()).collect()] == [61, 0, 0, 1]


def test_on_scale(rows):
    df = rows("rating double", (0.49,), (0.5,), (5.0,), (5.01,), (None,), (float("nan"),))
    assert [r[0] for r in df.select(tg.on_scale()).collect()] == [False, True, True, False, False, False]


def test_als_norm_is_clamped(rows):
    df = rows("als_score double", (-1.0,), (0.5,), (2.75,), (5.0,), (9.0,))
    assert [r[0] for r in df.select(tg.als_norm()).collect()] == [0.0, 0.0, 0.5, 1.0, 1.0]


def test_request_key(rows):
    df = rows("u int, n int, g string", (1, 10, " Drama "), (1, 10, "drama"), (1, 10, None), (1, 10, "  "))
    keys = [r[0] for r in df.select(tg.request_key("u", "n", "g")).collect()]
    assert keys == ["user=1:top=10:genre=drama"] * 2 + ["user=1:top=10:genre=all"] * 2


def test_ideal_dcg(rows):
    df = rows("n long", (0,), (1,), (2,), (5,), (None,))
    got = [r[0] for r in df.select(tg.ideal_dcg(F.col("n"), 3)).collect()]
    steps = [1 / math.log2(i + 2) for i in range(3)]
    assert got == pytest.approx([0.0, steps[0], sum(steps[:2]), sum(steps), 0.0])


def test_split_bucket_depends_on_the_pair_only(rows):
    df = rows("user_id int, item_id int", *[(u, i) for u in range(200) for i in range(50)])
    parts = df.withColumn("b", tg.split_bucket("user_id", "item_id", 42))
    assert tuples(parts.repartition(1)) == tuples(parts.repartition(3))
    share = parts.filter("b < 2000").count() / 10000
    assert 0.17 < share < 0.23
    other = parts.withColumn("c", tg.split_bucket("user_id", "item_id", 7)).filter("b < 2000 AND c < 2000").count()
    assert other < 1000


def test_split_bucket_of_extreme_ids(rows):
    df = rows("user_id int, item_id int", (2**31 - 1, 2**31 - 1), (-(2**31), 5))
    assert all(0 <= r[0] < 10000 for r in df.select(tg.split_bucket("user_id", "item_id", 1)).collect())
