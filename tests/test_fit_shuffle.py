"""A fit has fewer factor blocks than cores, and what follows it reads the ratings that it read."""

import pytest
from pyspark.sql import functions as F

from tastegrid import session
from tastegrid.config import AlsConfig
from tastegrid.operators import als
from tests.helpers import tuples
from workload.queries import QUERIES
from workload.views import Views


@pytest.mark.parametrize("cores, blocks", [(1, 5), (8, 5), (12, 5), (13, 6), (100, 40)])
def test_blocks_of_a_fit(spark, cores, blocks):
    estimator = als.als_estimator(parallelism=cores)
    assert estimator.getNumUserBlocks() == estimator.getNumItemBlocks() == blocks
    assert als.als_estimator(AlsConfig(blocks=12), cores).getNumItemBlocks() == 12


def test_predictions_keep_what_is_asked_for(ratings):
    rated = ratings((1, 1, 4.0, 1), (1, 2, 2.0, 2), (2, 1, 5.0, 3), (2, 3, 1.0, 4), (1, 1, 3.0, 5))
    model = als.als_fit(rated, AlsConfig(rank=2, max_iter=2, blocks=2))
    asked = rated.unionByName(ratings((9, 1, 3.0, 6), (1, 9, 3.0, 7)))
    plain, kept = als.als_predict(model, asked), als.als_predict(model, asked, keep=("ts",))
    assert plain.columns == ["user_id", "item_id", "rating", "prediction"]
    assert tuples(kept.drop("ts")) == tuples(plain) and [t for (t,) in tuples(kept, "ts")] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("name", ["als_predict", "als_candidates_subset"])
def test_ratings_are_computed_once(spark, tmp_path, monkeypatch, name):
    lines = [(o, (o * 7 + n) % 9, float(5 + (o + 3 * n) % 44), n) for o in range(40) for n in range(4)]
    orders = spark.createDataFrame([(o, o % 11) for o in range(40)], "o_orderkey long, o_custkey long")
    dated = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    dated.withColumn("l_shipdate", F.date_add(F.lit("2020-01-01").cast("date"), F.col("l_linenumber") * 300)).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"{tmp_path}/shared")
    read, found = [], Views.table
    monkeypatch.setattr(Views, "table", lambda view, name: read.append(name) or found(view, name))
    result = QUERIES[name](spark, str(tmp_path))
    assert result.count() > 0 and sorted(read) == ["lineitem", "orders"]
    if "sound" in result.columns:
        assert {r.sound for r in result.collect()} == {True}
