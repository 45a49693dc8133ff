"""Training job: fit, choose, evaluate and publish."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.config import (
    AlsConfig,
    BlendConfig,
    EvalConfig,
    FallbackConfig,
    GridConfig,
    PrecomputeConfig,
    SplitConfig,
)
from tastegrid.operators.als import als_candidates_all, als_candidates_subset, als_fit, als_predict
from tastegrid.operators.cleaning import merge_feedback
from tastegrid.operators.evaluate import rmse
from tastegrid.operators.fallback import fallback_all
from tastegrid.operators.split import train_test
from tastegrid.plans.hybrid import hybrid_precomputed, hybrid_ranking_eval
from tastegrid.session import release, reuse
from tastegrid.sources.raw import read_feedback
from tastegrid.sources.releases import current, publish
from tastegrid.sources.tables import (
    append_ranking_metrics,
    append_trials,
    latest_version,
    load_als_model,
    read_gold_fallback,
    read_gold_precomputed,
    read_silver_items,
    read_silver_ratings,
    save_model_version,
    trial_rows,
    write_gold_fallback,
    write_gold_precomputed,
)


@dataclass(frozen=True)
class TrainingConfig:
    als: AlsConfig = field(default_factory=AlsConfig)
    grid: GridConfig = field(default_factory=GridConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    blend: BlendConfig = field(default_factory=BlendConfig)
    evaluation: EvalConfig = field(default_factory=EvalConfig)
    precompute: PrecomputeConfig = field(default_factory=PrecomputeConfig)
    fallback: FallbackConfig = field(default_factory=FallbackConfig)
    # Stored lists are made deep enough to answer requests of this size.
    largest_request: int = 50


#: The folders of a release: model versions, stored lists, fallback lists.
RELEASE_PARTS = ("models", "gold_precomputed", "gold_fallback")


@dataclass(frozen=True)
class StorePaths:
    silver_ratings: str
    silver_items: str
    feedback: str
    models: str
    trials: str
    metrics: str
    gold_precomputed: str
    gold_fallback: str


#: Ratings in a factor block of a grid's trial.
BLOCK_RATINGS = 10_000_000


def trial_blocks(ratings: int, cores: int, at_once: int) -> int:
    """Factor blocks of each of ``at_once`` trials: their share of the cores, and more where blocks would grow too large.

    An iteration sends every factor to each block that rates it, nearly all of them, so that the shuffle is in proportion
    to the number of blocks; trials that run side by side need no more blocks than cores in all.
    """
    return max(1, -(-cores // max(1, at_once)), -(-ratings // BLOCK_RATINGS))


def longest_first(settings: list[tuple[int, tuple[int, float, int]]]) -> list[tuple[int, tuple[int, float, int]]]:
    """Numbered trials by falling work, which is iterations times the square of the rank; equal ones by number."""
    return sorted(settings, key=lambda trial: (-(trial[1][0] ** 2) * trial[1][2], trial[0]))


def als_grid(
    train: DataFrame, test: DataFrame, base: AlsConfig = AlsConfig(), grid: GridConfig = GridConfig(), parallelism: int = 4
) -> tuple[ALSModel, list[dict]]:
    """Fit every combination of the grid and keep the model with the lowest error (the first among equals).

    Trials with the most work start first, so that none of them runs alone at the end. Up to ``parallelism`` trials run at a
    time, each from a thread and, where the session schedules fairly, in a pool of
    its own: a fit has many short jobs and stages that leave cores idle. With ``base.blocks`` set, trials and winner do not
    depend on it; else each trial gets the blocks of its share of the cores (``trial_blocks``). Only the errors come back, one number per trial; pass ``train`` and ``test`` through ``reuse`` first, since every trial reads
    both.
    """
    spark = train.sparkSession
    settings = list(enumerate(product(grid.ranks, grid.reg_params, grid.max_iters), start=1))
    at_once = min(parallelism, len(settings))
    blocks = base.blocks or trial_blocks(train.count(), spark.sparkContext.defaultParallelism, at_once)

    def attempt(trial: tuple[int, tuple[int, float, int]]) -> tuple[dict, ALSModel]:
        trial_no, (rank, reg, iterations) = trial
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"als-trial-{trial_no % parallelism}")
        model = als_fit(train, replace(base, rank=rank, reg_param=reg, max_iter=iterations, blocks=blocks))
        error = rmse(als_predict(model, test)).head()["rmse"]
        return dict(trial_no=trial_no, rank=rank, reg_param=reg, max_iter=iterations, rmse=error), model

    best, trials = None, []
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        # Of the models only the best so far is held.
        for trial, model in pool.map(inheritable_thread_target(spark)(attempt), longest_first(settings)):
            trials.append(trial)
            if trial["rmse"] is not None and (best is None or (trial["rmse"], trial["trial_no"]) < best[0]):
                best = (trial["rmse"], trial["trial_no"]), model
    if best is None:
        raise ValueError("no trial gave a model: train or test holds no usable pair")
    return best[1], sorted(trials, key=lambda trial: trial["trial_no"])


def run_training(spark: SparkSession, paths: StorePaths, config: TrainingConfig = TrainingConfig(), releases: str | None = None) -> dict:
    """Train on the silver ratings and the feedback, then replace model and gold tables.

    With ``releases``, model, stored lists and fallback lists go to a release of the run there instead of the paths for
    them, and become visible together when all are written (``published`` reads them); a run that fails changes nothing.

    Returns the model's path, the run and its trials, and how many users have fewer stored recommendations than asked for.
    """
    items = read_silver_items(spark, paths.silver_items)
    merged = merge_feedback(read_silver_ratings(spark, paths.silver_ratings), read_feedback(spark, paths.feedback))
    ratings = reuse(merged)
    train, test = (reuse(side) for side in train_test(ratings, config.split))

    model, trials = als_grid(train, test, config.als, config.grid)
    run_id = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    append_trials(trial_rows(spark, trials, run_id), paths.trials)

    depth = max(config.blend.candidate_top_k, config.evaluation.k)
    test_candidates = als_candidates_subset(model, test, depth)
    metrics = hybrid_ranking_eval(test_candidates, train, test, items, config.blend, config.evaluation)
    append_ranking_metrics(metrics, paths.metrics)

    store = replace(config.precompute, top_n=max(config.precompute.top_n, config.largest_request))
    depth = max(config.blend.candidate_top_k, store.top_n) + store.over_fetch
    candidates = als_candidates_all(model, depth)
    precomputed = hybrid_precomputed(candidates, ratings, items, config.blend, store)
    listed = replace(config.fallback, top_n=max(config.fallback.top_n, config.largest_request))

    def write(models: str, gold_precomputed: str, gold_fallback: str) -> str:
        version = save_model_version(model, models, spark)
        write_gold_precomputed(precomputed, gold_precomputed, config.precompute.buckets)
        write_gold_fallback(fallback_all(ratings, items, listed), gold_fallback)
        return version

    if releases is None:
        version_path, lists = write(paths.models, paths.gold_precomputed, paths.gold_fallback), paths.gold_precomputed
    else:
        folder = publish(spark, releases, run_id, lambda f: write(*(f"{f}/{part}" for part in RELEASE_PARTS)))
        version_path, lists = latest_version(spark, f"{folder}/{RELEASE_PARTS[0]}").head()["path"], f"{folder}/{RELEASE_PARTS[1]}"
    stored = read_gold_precomputed(spark, lists).groupBy("user_id").count()
    everyone = ratings.select("user_id").distinct().join(stored, "user_id", "left")
    short = everyone.filter(F.coalesce("count", F.lit(0)) < store.top_n).count()

    for kept in (train, test, ratings):
        release(kept)
    return {"model_path": version_path, "run_id": run_id, "trials": trials, "short_users": short}


def published(spark: SparkSession, releases: str) -> tuple[ALSModel, DataFrame, DataFrame] | None:
    """Model, stored lists and fallback lists of the current release, all of one run; None before the first."""
    folder = current(spark, releases)
    if folder is None:
        return None
    models, lists, fallback = (f"{folder}/{part}" for part in RELEASE_PARTS)
    return load_als_model(models), read_gold_precomputed(spark, lists), read_gold_fallback(spark, fallback)


def retrain_job(spark: SparkSession, paths: StorePaths, config: TrainingConfig = TrainingConfig(), releases: str | None = None) -> dict:
    """Training after feedback came in.  The session is the caller's and stays up."""
    return run_training(spark, paths, config, releases)
