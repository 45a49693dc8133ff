"""Factor blocks of the trials of a grid."""

from tastegrid.config import AlsConfig, GridConfig
from tastegrid.operators.als import CHECKPOINT_EVERY, als_estimator
from tastegrid.plans import training


def test_trials_side_by_side_share_the_cores():
    assert training.trial_blocks(1_000, cores=12, at_once=4) == 3
    assert training.trial_blocks(1_000, cores=12, at_once=1) == 12
    assert training.trial_blocks(1_000, cores=2, at_once=4) == 1
    assert training.trial_blocks(0, cores=1, at_once=0) == 1
    # Blocks stay bounded where the ratings are many.
    assert training.trial_blocks(45_000_001, cores=12, at_once=4) == 5


def test_a_grid_hands_its_trials_their_blocks(spark, monkeypatch):
    ratings = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(6) for i in range(8)], "user_id int, item_id int, rating double")
    used, fit = [], training.als_fit
    monkeypatch.setattr(training, "als_fit", lambda train, config: used.append(config.blocks) or fit(train, config))
    grid = GridConfig(ranks=(2,), reg_params=(0.1, 0.5), max_iters=(1,))
    training.als_grid(ratings, ratings, grid=grid, parallelism=2)
    assert used == [training.trial_blocks(48, spark.sparkContext.defaultParallelism, 2)] * 2
    used.clear()
    training.als_grid(ratings, ratings, AlsConfig(blocks=3), grid, parallelism=2)
    assert used == [3, 3]


def test_shuffles_of_earlier_iterations_can_be_deleted():
    assert als_estimator(AlsConfig(max_iter=10)).getCheckpointInterval() == CHECKPOINT_EVERY < 10
