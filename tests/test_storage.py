import glob
import os

import pytest
from pyspark.sql import functions as F

from tastegrid import AlsConfig, GridConfig, PrecomputeConfig
from tastegrid.config import FallbackConfig
from tastegrid.operators.als import als_candidates_all, als_candidates_subset, als_enriched, als_fit, als_predict
from tastegrid.operators import cleaning, serving
from tastegrid.operators.fallback import fallback_all
from tastegrid.plans import training
from tastegrid.plans.etl import run_etl
from tastegrid.plans.training import StorePaths, TrainingConfig, retrain_job
from tastegrid.session import release, reuse
from tastegrid.sources import raw, releases, tables
from tests.helpers import plan, tuples
from workload.views import Views


def text(path, content, encoding="utf-8"):
    path.write_bytes(content.encode(encoding))
    return str(path)


def test_dat_files(spark, tmp_path):
    ratings = text(tmp_path / "ratings.dat", "1::2::3.5::978300760\n1::x::4::5\n7::8::0.5::1\n")
    assert tuples(raw.read_ratings(spark, ratings)) == [(1, 2, 3.5, 978300760), (1, None, 4.0, 5), (7, 8, 0.5, 1)]
    items = text(tmp_path / "movies.dat", "1::Café Noir (1995)::Drama|War\n", "iso-8859-1")
    assert tuples(raw.read_items(spark, items)) == [(1, "Café Noir (1995)", "Drama|War")]


@pytest.mark.parametrize("header", ["", "userId,movieId,rating,timestamp\n", "user_id,item_id,rating,ts\n"])
def test_header_is_found(spark, tmp_path, header):
    path = text(tmp_path / "r.csv", header + "1,2,3.0,4\n")
    assert raw.has_header(spark, path) == bool(header)
    assert tuples(raw.read_ratings(spark, path)) == [(1, 2, 3.0, 4)]


def test_quoted_titles(spark, tmp_path):
    path = text(tmp_path / "i.csv", 'movieId,title,genres\n1,"A, B (2000)",x|y\n')
    assert tuples(raw.read_items(spark, path)) == [(1, "A, B (2000)", "x|y")]


def test_missing_feedback_is_none(spark, tmp_path):
    assert raw.read_feedback(spark, str(tmp_path / "none.csv")) is None
    path = text(tmp_path / "f.csv", "userId,movieId,rating,timestamp\n9,1,4.0,17\n")
    assert tuples(raw.read_feedback(spark, path)) == [(9, 1, 4.0, 17)]


def test_silver_round_trip_and_pruning(spark, tmp_path, ratings):
    df = ratings(*[(u, i, 3.0, u) for u in range(-3, 130) for i in range(3)])
    path = str(tmp_path / "silver")
    tables.write_silver_ratings(df, path)
    assert len([d for d in os.listdir(path) if d.startswith("user_bucket=")]) == 64
    stored = tables.read_silver_ratings(spark, path)
    assert tuples(stored.drop("user_bucket")) == tuples(df)
    mine = tables.for_user(stored, 65)
    assert tuples(mine, "user_id", "user_bucket") == [(65, 1)] * 3
    assert "PartitionFilters: [isnotnull(user_bucket" in plan(mine)
    wanted = tables.in_buckets_of(stored, df.filter("user_id IN (-3, 4)"))
    assert {r[0] for r in tuples(wanted, "user_id")} == {-3, 4}


def test_any_number_of_buckets_reads_back_whole(spark, tmp_path, ratings):
    df = ratings(*[(u, i, 3.0, u) for u in range(200) for i in range(2)])
    path = str(tmp_path / "silver")
    tables.write_silver_ratings(df, path, buckets=16)
    stored = tables.read_silver_ratings(spark, path)
    assert tuples(tables.in_buckets_of(stored, df), "user_id", "item_id") == tuples(df, "user_id", "item_id")
    assert tables.for_user(stored, 77).count() == 2
    unmarked = spark.read.schema(stored.schema).parquet(path).withMetadata("user_bucket", {})
    assert tables.in_buckets_of(unmarked, df).count() == 400 and tables.for_user(unmarked, 77).count() == 2
    served = serving.user_has_history(df.filter("user_id = 3").select("user_id").distinct(), stored)
    scan = [line for line in plan(served).splitlines() if "PartitionFilters" in line]
    assert any("array_contains" in line.split("PartitionFilters")[1] for line in scan)
    assert served.filter("has_history").count() == 1


def test_fallback_is_rebuilt_once(spark, tmp_path, ratings, items):
    path, built = str(tmp_path / "fallback"), []

    def build():
        built.append(1)
        return fallback_all(ratings((1, 1, 4.0, 1)), items((1, "A", "x")), FallbackConfig(min_rating_count=1))

    for _ in range(2):
        assert tables.read_gold_fallback(spark, path, build).count() == 2
    assert len(built) == 1
    for file in glob.glob(f"{path}/part-*"):
        with open(file, "w") as damaged:
            damaged.write("damaged")
    assert tables.read_gold_fallback(spark, path, build).count() == 2 and len(built) == 2


def test_etl_job(spark, tmp_path):
    ratings = text(tmp_path / "ratings.dat", "1::2::3.5::7\n1::2::4.5::7\n1::2::9::8\n")
    items = text(tmp_path / "movies.dat", "2::B (1990)::x\n2::A (1990)::x\n")
    out = [str(tmp_path / name) for name in ("sr", "si")]
    stats = run_etl(spark, ratings, items, *out)
    assert tuples(stats) == [("items", 2, 1, 1), ("ratings", 3, 1, 2)]
    assert tuples(tables.read_silver_ratings(spark, out[0])) == [(1, 2, 4.5, 7, 1)]
    assert tuples(tables.read_silver_items(spark, out[1])) == [(2, "A (1990)", "x")]


@pytest.fixture(scope="module")
def fitted(spark, small_dir):
    view = Views(spark, small_dir)
    train, test = view.train_test()
    return view, train, test, als_fit(train, AlsConfig(rank=4, max_iter=3, blocks=2))


def test_als_invariants(fitted):
    view, train, test, model = fitted
    assert all(min(r.features) >= 0 for r in model.userFactors.collect() + model.itemFactors.collect())
    predicted = als_predict(model, test)
    assert 0 < predicted.count() <= test.count() and predicted.filter("isnan(prediction)").count() == 0
    every = als_candidates_all(model, 7)
    per_user = every.groupBy("user_id").count().collect()
    assert {r["count"] for r in per_user} == {7} and len(per_user) == train.select("user_id").distinct().count()
    few = als_candidates_subset(model, view.ratings().filter("user_id < 5"), 7)
    assert {r[0] for r in tuples(few, "user_id")} == {0, 1, 2, 3, 4}


def test_titles_beside_candidates(fitted):
    view, _, _, model = fitted
    some = als_candidates_all(model, 3)
    named = als_enriched(some, view.items())
    assert tuples(named, "user_id", "item_id") == tuples(some, "user_id", "item_id")
    assert named.join(view.items(), ["item_id", "title", "genres"]).count() == named.filter("title IS NOT NULL").count() > 0


def test_model_versions(spark, fitted, tmp_path):
    model = fitted[3]
    older = tables.save_model_version(model, str(tmp_path), spark)
    path = tables.save_model_version(model, str(tmp_path), spark)
    assert tables.latest_version(spark, str(tmp_path)).head()["path"] == path != older
    loaded = tables.load_als_model(str(tmp_path))
    assert loaded.rank == model.rank and tables.load_als_model(str(tmp_path / "nowhere")) is None
    (tmp_path / "broken" / "latest").mkdir(parents=True)
    (tmp_path / "broken" / "latest" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception):
        tables.load_als_model(str(tmp_path / "broken"))


def test_retrain_job(spark, small_dir, tmp_path):
    view = Views(spark, small_dir)
    paths = StorePaths(**{name: str(tmp_path / name) for name in StorePaths.__dataclass_fields__})
    tables.write_silver_ratings(view.ratings(), paths.silver_ratings)
    tables.write_silver_items(view.items(), paths.silver_items)
    view.feedback().write.option("header", True).csv(paths.feedback)
    config = TrainingConfig(
        als=AlsConfig(blocks=2),
        grid=GridConfig(ranks=(2, 4), reg_params=(0.1,), max_iters=(2,)),
        precompute=PrecomputeConfig(top_n=10),
        largest_request=30,
    )
    result = retrain_job(spark, paths, config)
    trials = spark.read.parquet(paths.trials).collect()
    assert {r.run_id for r in trials} == {result["run_id"]} and result["short_users"] >= 0
    assert sorted(r.rmse for r in trials) == sorted(t["rmse"] for t in result["trials"]) and len(trials) == 2
    metrics = spark.read.parquet(paths.metrics).head()
    assert all(0 <= metrics[name] <= 1 for name in ("precision_at_k", "recall_at_k", "ndcg_at_k"))
    assert metrics.algorithm == "hybrid_rerank" and metrics.evaluated_users > 0
    stored = tables.read_gold_precomputed(spark, paths.gold_precomputed)
    # Feedback took part: its pairs are seen, too.
    seen = view.merged().select("user_id", "item_id")
    assert seen.join(view.ratings(), ["user_id", "item_id"], "left_anti").count() > 0
    assert stored.join(seen, ["user_id", "item_id"]).count() == 0
    ranks = stored.groupBy("user_id").agg({"rank": "max", "item_id": "count"}).collect()
    assert all(r["max(rank)"] == r["count(item_id)"] <= 30 for r in ranks)
    out_of_range = "NOT (als_norm BETWEEN 0 AND 1 AND popularity_norm BETWEEN 0 AND 1 AND recency_norm BETWEEN 0 AND 1)"
    assert stored.filter(out_of_range).count() == 0
    assert tables.read_gold_fallback(spark, paths.gold_fallback).filter("fallback_type = 'global'").count() == 30
    asked = spark.createDataFrame([(1, 10**8, 30, None), (2, 10**8, 200, None)], "request_id long, user_id int, top_n int, genre string")
    lists = tables.read_gold_fallback(spark, paths.gold_fallback)
    answers = serving.serve_batch(asked, view.merged(), stored, lists).select("request_id", "short", F.size("recommendations")).collect()
    assert sorted(tuple(r) for r in answers) == [(1, False, 30), (2, True, 30)]
    spark.range(1).count()  # the session is still up


def test_a_failed_run_leaves_the_release_served(spark, small_dir, tmp_path, monkeypatch):
    view = Views(spark, small_dir)
    paths = StorePaths(**{name: str(tmp_path / name) for name in StorePaths.__dataclass_fields__})
    root = str(tmp_path / "releases")
    tables.write_silver_ratings(view.ratings(), paths.silver_ratings)
    tables.write_silver_items(view.items(), paths.silver_items)
    view.feedback().write.option("header", True).csv(paths.feedback)
    config = TrainingConfig(als=AlsConfig(blocks=2), grid=GridConfig(ranks=(2,), reg_params=(0.1,), max_iters=(2,)), precompute=PrecomputeConfig(top_n=5))
    assert training.published(spark, root) is None
    first = retrain_job(spark, paths, config, root)

    def answers():
        model, lists, fallback = training.published(spark, root)
        return model.rank, tuples(lists, "user_id", "item_id", "rank"), fallback.count()

    before, opened = answers(), training.published(spark, root)[1]

    def broken(fallback, path):
        raise OSError("disk full")

    with monkeypatch.context() as patch:
        patch.setattr(training, "write_gold_fallback", broken)
        with pytest.raises(OSError):
            retrain_job(spark, paths, config, root)
    assert answers() == before
    second = retrain_job(spark, paths, config, root)
    assert answers()[0] == 2 and releases.current(spark, root).endswith(second["run_id"])
    # Readers of the former release go on; what the failed run left is gone with the release before that.
    assert opened.count() == len(before[1])
    retrain_job(spark, paths, config, root)
    left = sorted(p.name for p in (tmp_path / "releases" / "runs").iterdir())
    assert len(left) == 2 and first["run_id"] not in left and left[0] == second["run_id"]


def test_trials_at_the_same_time_are_the_trials_one_by_one(fitted):
    _, train, test, _ = fitted
    grid = GridConfig(ranks=(2, 3), reg_params=(0.1, 0.5), max_iters=(2,))
    sides = [reuse(side) for side in (train, test)]
    one, several = (training.als_grid(*sides, AlsConfig(blocks=2), grid, parallelism=p) for p in (1, 4))
    for side in sides:
        release(side)
    assert [(t["trial_no"], t["rank"], t["reg_param"], round(t["rmse"], 6)) for t in one[1]] == [(t["trial_no"], t["rank"], t["reg_param"], round(t["rmse"], 6)) for t in several[1]]
    assert one[0].rank == several[0].rank


def test_each_raw_file_is_read_once(spark, tmp_path, monkeypatch):
    ratings = text(tmp_path / "ratings.dat", "1::2::3.5::7\n1::2::4.5::7\n1::2::9::8\n4::2::3::8\nx::y\n")
    items = text(tmp_path / "movies.dat", "2::B (1990)::x\n2::A (1990)::x\n3::C\n")
    read = spark.sparkContext.accumulator(0)
    real = raw.read_ratings
    from tastegrid.plans import etl

    def watched(*args):
        def passing(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        rows = real(*args)
        return rows.mapInArrow(passing, rows.schema)

    monkeypatch.setattr(etl, "read_ratings", watched)
    stats = etl.run_etl(spark, ratings, items, str(tmp_path / "sr"), str(tmp_path / "si"))
    assert tuples(stats) == [("items", 3, 1, 2), ("ratings", 5, 2, 3)]
    assert tuples(stats) == tuples(cleaning.clean_stats(real(spark, ratings), raw.read_items(spark, items)))
    assert tuples(tables.read_silver_ratings(spark, str(tmp_path / "sr")).drop("user_bucket")) == tuples(cleaning.clean_ratings(real(spark, ratings)))
    assert read.value == 5
