import math

import pytest

from tastegrid import EvalConfig, SplitConfig
from tastegrid.operators import evaluate, split, summaries
from tests.helpers import by, tuples


@pytest.fixture
def judged(rows, ratings):
    recs = rows(
        "user_id int, item_id int, rank int",
        (1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 13, 4),
        (2, 10, 2), (2, 11, 5),
        (3, 10, 1),
        (5, 10, 1), (5, 10, 2),
    )
    test = ratings(
        (1, 11, 4.0, 1), (1, 11, 5.0, 2), (1, 13, 5.0, 1), (1, 50, 4.0, 1), (1, 10, 3.5, 1),
        (2, 10, 5.0, 1),
        (3, 10, 1.0, 1),
        (4, 10, 5.0, 1),
        (5, 10, 5.0, 1),
    )
    return recs, test


def test_per_user(judged):
    found = by(evaluate.user_ranking_metrics(*judged, EvalConfig(k=3)), "user_id")
    # 3 has no relevant item, 4 no recommendation.
    assert sorted(found) == [1, 2, 5]
    assert found[1]["hit_count"] == 1 and found[1]["relevant_count"] == 3
    assert found[1]["dcg"] == pytest.approx(1 / math.log2(3))
    assert found[1]["idcg"] == pytest.approx(sum(1 / math.log2(i + 2) for i in range(3)))
    assert found[1]["precision_at_k"] == pytest.approx(1 / 3)
    # The rank of 2's first row is 2, but it is first in the list; its other row is beyond k.
    assert found[2]["dcg"] == 1.0 and found[2]["recall_at_k"] == 1.0 and found[2]["precision_at_k"] == pytest.approx(1 / 3)
    # An item listed twice is one hit with two gains.
    assert found[5]["hit_count"] == 1 and found[5]["dcg"] == pytest.approx(1 + 1 / math.log2(3))


def test_averages(judged):
    row = evaluate.ranking_metrics(*judged, EvalConfig(k=3)).head()
    assert row.evaluated_users == 3 and row.precision_at_k == pytest.approx(1 / 3)
    assert row.recall_at_k == pytest.approx((1 / 3 + 1 + 1) / 3)
    wider = evaluate.ranking_metrics(*judged, EvalConfig(k=3, include_missing=True)).head()
    assert wider.evaluated_users == 4 and wider.precision_at_k == pytest.approx(1 / 4)


def test_nothing_to_evaluate(judged):
    recs, test = judged
    row = evaluate.ranking_metrics(recs.filter("false"), test).head()
    assert (row.precision_at_k, row.recall_at_k, row.ndcg_at_k, row.evaluated_users) == (0.0, 0.0, 0.0, 0)
    with pytest.raises(ValueError):
        EvalConfig(k=0)


def test_lists(judged):
    recs, test = judged
    assert tuples(evaluate.recommended_list(recs, 3)) == [(1, [10, 11, 12]), (2, [10]), (3, [10]), (5, [10, 10])]
    assert len(tuples(evaluate.relevant_items(test))) == 6


def test_rmse(rows):
    df = rows("rating double, prediction double", (1.0, 2.0), (3.0, 3.0), (2.0, 4.0))
    assert evaluate.rmse(df).head()[0] == pytest.approx(math.sqrt(5 / 3))


def test_split_sides(ratings):
    df = ratings(*[(u, i, 3.0, t) for u in range(40) for i in range(25) for t in (1, 2)])
    train, test = split.train_test(df, SplitConfig(test_share=0.3, seed=1))
    assert train.count() + test.count() == df.count()
    pairs = [set(tuples(side, "user_id", "item_id")) for side in (train, test)]
    assert not pairs[0] & pairs[1]


def test_best_trial_takes_the_first_of_equals(rows):
    trials = rows(
        "run_id string, trial_no int, rank int, reg_param double, max_iter int, rmse double",
        ("b", 2, 8, 0.1, 5, 0.9), ("b", 1, 4, 0.1, 5, 0.9), ("b", 3, 2, 0.1, 5, 1.0), ("b", 4, 1, 0.1, 5, None),
        ("a", 1, 64, 0.1, 5, 0.1),
    )
    assert tuple(summaries.best_trial(trials).head()) == (0.9, 4, 0.1, 5, 3)
    assert tuple(summaries.best_trial(trials, all_runs=True).head()) == (0.1, 64, 0.1, 5, 4)


def test_latest_metrics(rows):
    metrics = rows("timestamp_utc string, k int", ("2024-01-02", 5), ("2024-01-03", 6), ("2023-01-01", 7))
    assert tuple(summaries.latest_metrics(metrics).head()) == ("2024-01-03", 6)
