"""The forest's trees against MLlib's, its draws, and that neither cores nor blocks change it."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from stockflow.operators import forecast, forest

INPUTS = list("abcd")


def _rows(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c, d = rng.integers(0, 9, n), rng.integers(0, 60, n), rng.normal(size=n).round(3), rng.integers(0, 2, n)
    y = (2 * a + np.where(b > 30, 8 * c, 0) + rng.integers(0, 5, n)).round()
    rows = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, d, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y double")


def _like(**more):
    return RandomForestRegressor(featuresCol="features", labelCol="y", predictionCol="p", featureSubsetStrategy="all", seed=5, **more)


def _assembled(df):
    return VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="keep").transform(df)


def _predicted(model, df):
    return {r.row_id: r.p for r in model.transform(df).select("row_id", "p").collect()}


@pytest.mark.parametrize("depth,least", [(0, 1), (1, 1), (6, 1), (5, 40)])
def test_a_tree_without_draws_is_mllibs(spark, depth, least):
    df = _assembled(_rows(spark)).cache()
    like = _like(numTrees=1, bootstrap=False, maxDepth=depth, minInstancesPerNode=least)
    theirs, ours = like.fit(df), forest.HistogramForest(like, INPUTS).fit(df)
    assert ours.totalNumNodes == theirs.totalNumNodes
    assert _predicted(ours, df) == pytest.approx(_predicted(theirs, df), rel=1e-12)
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray())


def test_a_forest_with_draws_is_as_good_as_mllibs_and_can_be_saved(spark, tmp_dir):
    df = _assembled(_rows(spark)).cache()
    like = _like(numTrees=20, maxDepth=6)
    y = {r.row_id: r.y for r in df.collect()}

    def error(model):
        return math.sqrt(np.mean([(p - y[i]) ** 2 for i, p in _predicted(model, df).items()]))
    ours = forest.HistogramForest(like, INPUTS).fit(df)
    assert error(ours) == pytest.approx(error(like.fit(df)), rel=0.03)
    assert len({t.toDebugString.split("\n", 1)[1] for t in ours.trees}) == ours.getNumTrees == 20  # each has its own draws
    ours.save(f"{tmp_dir}/forest")
    assert _predicted(type(ours).load(f"{tmp_dir}/forest"), df) == _predicted(ours, df)


def test_the_model_depends_on_the_rows_alone(spark, monkeypatch):
    df = _assembled(_rows(spark))
    fit = lambda d: _predicted(forest.HistogramForest(_like(numTrees=8, maxDepth=6), INPUTS).fit(d), df)
    whole = fit(df.coalesce(1))
    assert fit(df.repartition(7)) == whole
    for name, small in {"BLOCK_ROWS": 200, "CHUNK_ROWS": 500, "NODES": 6, "PART": 2, "PARTITIONS": 3, "LEAST_ROWS": 400}.items():
        monkeypatch.setattr(forest, name, small)
    assert fit(df.repartition(5)) == whole


def test_training_rows_are_numbered_so_files_dont_matter(spark):
    from test_forecast import _weekly
    from stockflow.operators import weekly
    train = forecast.training_table(weekly.with_baseline(_weekly(spark, n_skus=5)))
    assert train.select(forest.ROW_ID).distinct().count() == train.count() == 5 * 70
    p = forecast.ForecastParams(max_depth=4)
    models = [forecast.build_pipeline(p, 3).fit(t) for t in (train, train.repartition(9), train.coalesce(1))]
    scored = [sorted(map(tuple, m.transform(train).select("sku_id", "date", "ml_forecast").collect())) for m in models]
    assert scored[0] == scored[1] == scored[2]


def test_draws_are_poisson():
    keys = forest._mix(np.arange(400_000, dtype=np.uint64))
    n, other = forest.draws(keys, 42, 0), forest.draws(keys, 42, 1)
    for k in range(5):
        assert abs((n == k).mean() - math.exp(-1) / math.factorial(k)) < 0.004
    assert abs(np.corrcoef(n, other)[0, 1]) < 0.01 and (forest.draws(keys, 42, 0) == n).all()
    u = np.array([0, *(int(s) + i for s in forest.STEPS[:8] for i in (-1, 0))], np.uint64)
    assert [int(np.searchsorted(forest.STEPS, x, "right")) for x in u] == [0, *(k + i for k in range(8) for i in (0, 1))]


def test_nan_inputs_and_bad_labels(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float("nan") if i % 3 == 1 else float(i), 0.0, 0.0, 0.0, 50.0 if i % 3 < 2 else 1.0) for i in range(90)],
                               "row_id long, a double, b double, c double, d double, y double")
    like = _like(numTrees=1, bootstrap=False, maxDepth=2)
    m = forest.HistogramForest(like, INPUTS).fit(df)
    assert {(r.y, r.p) for r in m.transform(_assembled(df)).collect()} == {(50.0, 50.0), (1.0, 1.0)}
    with pytest.raises(Exception, match="label is null or NaN"):
        forest.HistogramForest(like, INPUTS).fit(df.withColumn("y", F.when(F.col("row_id") == 7, F.lit(None)).otherwise(F.col("y"))))
    with pytest.raises(ValueError, match="no rows"):
        forest.HistogramForest(like, INPUTS).fit(df.limit(0))


def test_tasks_of_a_level_are_even():
    assert forest.task_count(10, 8) == 1 and forest.task_count(2_106_000, 8) == 8
    assert forest.task_count(21_060_000, 8) == forest.task_count(21_060_000, 12) == 24


def test_thresholds_of_few_and_many_values():
    assert forest.thresholds(np.array([1.0, 1.0, 3.0, 2.0]), 32).tolist() == [1.5, 2.5]
    assert len(forest.thresholds(np.full(9, 4.0), 32)) == 0
    many = forest.thresholds(np.arange(10_000.0), 32)
    assert len(many) == 31 and abs(many[15] - 5000) < 200
    assert forest.thresholds(np.array([1.0, 2.0, np.nan]), 32).tolist() == [1.5, 2.0]
