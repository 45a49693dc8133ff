"""Re-ranking against a brute-force computation that ranks everything before it cuts."""

import random
import re
from collections import defaultdict

import pytest

from tastegrid import BlendConfig
from tastegrid.operators.explain import explain
from tastegrid.operators.ranking import top_k
from tastegrid.operators.rerank import deepest_useful_rank, recency_norm, rerank, year_extent
from tests.helpers import by, plan, tuples

SCHEMA = (
    "user_id int, item_id int, als_score double, content_score double, max_genre_weight double, "
    "primary_genre string, release_year int, popularity_norm double"
)


def random_rows(seed, users=4, items=60):
    chance = random.Random(seed)
    found = []
    for user in range(users):
        for item in range(items if user else items * 4):
            found.append(
                (
                    user,
                    item,
                    chance.choice([0.2, 0.5, 2.75, 4.9, 5.3]),
                    chance.randrange(0, 5) / 4,
                    chance.randrange(0, 5) / 4,
                    chance.choice(["a", "b", "c", None]),
                    chance.choice([None, 1990, 2000, 2010]),
                    chance.choice([None, 0.0, 0.5, 1.0]),
                )
            )
    return found


def brute_force(found, top_n, config):
    years = [r[6] for r in found if r[6] is not None]
    lowest, highest = (min(years), max(years)) if years else (None, None)
    groups = defaultdict(list)
    for user, item, als, content, weight, genre, year, liked in found:
        norm = max(0.0, min(1.0, (als - 0.5) / 4.5))
        blend = config.als_weight * norm + config.content_weight * content
        recent = (year - lowest) / (highest - lowest) if year is not None and highest > lowest else 0.0
        groups[user, genre].append((-round(blend, 9), -(liked or 0.0), item, weight, recent))
    scored = defaultdict(list)
    for (user, _), members in groups.items():
        for place, (blend, liked, item, weight, recent) in enumerate(sorted(members)):
            total = -blend + config.genre_boost * weight - config.popularity_boost * liked
            total += config.recency_boost * recent - config.diversity_penalty * place
            scored[user].append((-round(total, 9), blend, liked, item, place + 1))
    best = {}
    for user, members in scored.items():
        for rank, (total, _, _, item, place) in enumerate(sorted(members)[:top_n], start=1):
            best[user, rank] = (item, place, pytest.approx(-total, abs=1e-8))
    return best


@pytest.mark.parametrize(
    "config",
    [
        BlendConfig(),
        BlendConfig(diversity_penalty=0.0),
        BlendConfig(diversity_penalty=0.01),
        BlendConfig(genre_boost=-0.3, diversity_penalty=0.5),
    ],
)
@pytest.mark.parametrize("top_n", [1, 5])
def test_rerank_equals_brute_force(rows, config, top_n):
    found = random_rows(top_n)
    df = rows(SCHEMA, *found)
    result = by(rerank(df, year_extent(df), top_n, config), "user_id", "rank")
    got = {key: (row["item_id"], row["genre_rank"], row["rerank_score"]) for key, row in result.items()}
    assert got == brute_force(found, top_n, config)


def test_deepest_useful_rank():
    assert deepest_useful_rank(10, BlendConfig()) == 13
    assert deepest_useful_rank(10, BlendConfig(diversity_penalty=0.0)) is None


def test_recency_without_width(rows):
    df = rows("item_id int, release_year int", (1, 2000), (2, None))
    assert [r[2] for r in recency_norm(df, year_extent(df)).collect()] == [0.0, 0.0]
    bare = rows("item_id int, release_year int", (1, None))
    assert recency_norm(bare, year_extent(bare)).head()["recency_norm"] == 0.0
    wide = rows("item_id int, release_year int", (1, 2000), (2, 2010), (3, 2005))
    assert tuples(recency_norm(wide, year_extent(wide)), "item_id", "recency_norm") == [(1, 0.0), (2, 1.0), (3, 0.5)]


@pytest.mark.parametrize("colocated", [False, True])
@pytest.mark.parametrize("k", [1, 3, 2000])
def test_top_k_is_the_same_in_slices(rows, k, colocated):
    df = rows("g int, i int, s int", *[(i % 3 if i < 300 else 0, i, i * 7919 % 101) for i in range(900)])
    order = [df.s.desc(), df.i.asc()]
    got = by(top_k(df, ["g"], order, k, spread_by=["i"], colocated=colocated), "g", "rank")
    for group in range(3):
        members = sorted((-r.s, r.i) for r in df.filter(df.g == group).collect())[:k]
        assert [got[group, n + 1]["i"] for n in range(len(members))] == [i for _, i in members]


def test_explain_texts(rows):
    df = rows(
        "anchor_title string, rating_count long, primary_genre string, favorite_genre string",
        ("Heat", 3, "Drama", "Action"),
        (None, None, None, "Action"),
        (None, None, None, None),
    )
    assert [r.explain for r in explain(df).collect()] == [
        "Because you liked Heat; Users similar to you liked this (3 ratings); Matches your favorite genre: Drama",
        "Because you liked similar movies; Users similar to you liked this (0 ratings); Matches your favorite genre: Action",
        "Because you liked similar movies; Users similar to you liked this (0 ratings); Matches your favorite genre: Mixed",
    ]


def test_without_a_penalty_no_task_holds_a_hot_group(rows):
    found = random_rows(8, users=3, items=50)
    found += [(7, 1000 + n, (n % 37) / 8, (n % 5) / 4, 0.5, "hot", 1990 + n % 9, [None, 0.5][n % 2]) for n in range(400)]
    found += [(7, 2000, None, 0.0, 0.0, "hot", None, None)]
    df = rows(SCHEMA, *found)
    config = BlendConfig(diversity_penalty=0.0)
    ranked = rerank(df, year_extent(df), 20, config)
    got = {(r["user_id"], r["rank"]): (r["item_id"], r["genre_rank"], r["rerank_score"]) for r in ranked.collect()}
    assert got == brute_force([r for r in found if r[2] is not None], 20, config)
    text = plan(ranked, run=True)
    assert "row_number() windowspecdefinition(user_id" in text and "windowspecdefinition(user_id#" in text
    assert not re.search(r"windowspecdefinition\(user_id#\d+, primary_genre#\d+, _quality", text)
