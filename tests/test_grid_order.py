"""The grid starts its longest trials first, and answers in the order of the trials."""

from itertools import product

import pytest

from tastegrid.config import AlsConfig, GridConfig
from tastegrid.plans import training


def test_work_falls():
    grid = GridConfig()
    settings = list(enumerate(product(grid.ranks, grid.reg_params, grid.max_iters), start=1))
    assert [no for no, _ in training.longest_first(settings)] == [6, 8, 5, 7, 2, 4, 1, 3]


def test_the_first_among_equals_wins_whatever_ran_first(spark, monkeypatch):
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(6) for i in range(8)], "user_id int, item_id int, rating double")
    started, fit = [], training.als_fit
    monkeypatch.setattr(training, "als_fit", lambda train, config: started.append((config.rank, config.max_iter)) or fit(train, config))
    # Equal settings give equal errors.
    grid = GridConfig(ranks=(2, 3), reg_params=(0.1, 0.1), max_iters=(1,))
    model, trials = training.als_grid(ratings, ratings, AlsConfig(blocks=2), grid, parallelism=1)
    assert started == [(3, 1), (3, 1), (2, 1), (2, 1)]
    assert [t["trial_no"] for t in trials] == [1, 2, 3, 4] and trials[0]["rmse"] == pytest.approx(trials[1]["rmse"])
    lowest = min(trials, key=lambda t: (t["rmse"], t["trial_no"]))
    assert model.rank == lowest["rank"]
