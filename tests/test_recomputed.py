"""Fitted models against a second computation: folds, node tables, segments, stored versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from emporia.operators import customers, sales_model, trees, validation
from emporia.sources import store
from emporia.sources.store import work_table

NUMBERS = ["month", "day_of_week"]


@pytest.fixture(scope="module")
def sold(spark):
    """Monthly revenues with places that only some folds have seen, and some empty folds' worth of ties."""
    draw = random.Random(5)
    rows = []
    for i in range(400):
        c, d = draw.choice("abc"), draw.choice(["north", "south"])
        place = f"{d}-{draw.randrange(4)}" if i % 40 else f"only-{i}"
        m, w = draw.randrange(1, 13), draw.randrange(7)
        rows.append((c, d, place, m, w, 100.0 * "abc".index(c) + 10 * m + 5 * w + draw.random() * 60))
    rows = list({r[:5]: r for r in rows}.values())
    return work_table(spark.createDataFrame(rows, "category string, delegation string, locality string, month int, day_of_week int, revenue double"))


def refitted_ridge(table, fold: int, alpha: float = 1.0) -> float:
    """R² of a closed form over the explicit one-hot columns of the other folds."""
    train = (table.fold != fold).to_numpy()
    known = table[train]
    numbers = (table[NUMBERS] - known[NUMBERS].mean()) / known[NUMBERS].std(ddof=0)
    columns = [numbers.to_numpy()]
    for c in sales_model.PLACE:
        columns.append((table[c].to_numpy()[:, None] == np.array(sorted(known[c].unique()))[None, :]).astype(float))
    x, y = np.hstack(columns), table.revenue.to_numpy()
    x, shift = x - x[train].mean(axis=0), y[train].mean()
    w = np.linalg.solve(x[train].T @ x[train] + alpha * np.eye(x.shape[1]), x[train].T @ (y[train] - shift))
    off, own = y[~train] - x[~train] @ w - shift, y[~train]
    return 1 - (off**2).sum() / ((own - own.mean()) ** 2).sum()


@pytest.mark.parametrize("folds", [2, 5])
def test_ridge_folds_equal_a_refit(sold, folds):
    found = {r.fold: r.r2 for r in sales_model.fold_scores(sold, "Ridge", folds=folds).collect()}
    table = validation.fold_rows(sold, sales_model.PLACE, NUMBERS, folds, 42).toPandas()
    assert found == {k: pytest.approx(refitted_ridge(table, k), abs=1e-9) for k in range(folds)}
    row = sales_model.cross_validate(sold, "Ridge", folds=folds).first()
    assert row.r2_mean == pytest.approx(np.mean(list(found.values()))) and row.r2_std == pytest.approx(np.std(list(found.values())))


def test_codes_are_means_of_the_other_folds(sold):
    rows = validation.fold_rows(sold, sales_model.PLACE, NUMBERS, 3, 42)
    table = rows.toPandas()
    for r in validation.coded(rows, sales_model.PLACE, NUMBERS, 3).where("fold = test").collect():
        others = table[table.fold != r.test]
        assert any(
            all(
                abs(r[f"{c}_code"] - (others[others[c] == own[c]].revenue.mean() if (others[c] == own[c]).any() else others.revenue.mean())) < 1e-9
                for c in sales_model.PLACE
            )
            for _, own in table[(table.fold == r.test) & (abs(table.revenue - r.revenue) < 1e-9)].iterrows()
        )


@pytest.mark.parametrize("kind", ["RandomForest", "GradientBoosting"])
def test_tree_folds(sold, kind, monkeypatch):
    monkeypatch.setattr(validation, "TREES_AT_ONCE", 4)
    found = sales_model.fold_scores(sold, kind, trees=10, rounds=10, folds=3).collect()
    assert sorted(r.fold for r in found) == [0, 1, 2] and all(0.7 < r.r2 < 1 for r in found)


@pytest.fixture(scope="module")
def points(spark):
    draw = random.Random(1)
    rows = [(i, draw.random(), float(draw.randrange(3)), draw.random() * 9) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, c double")
    return work_table(frame.withColumn("label", F.expr("double(a * 4 + b * b + if(c > 5, 3, 0))")).withColumn("class", F.expr("int(label) % 3")))


@pytest.mark.parametrize(
    ("kind", "learner", "settings"),
    [
        ("mean", RandomForestRegressor, dict(labelCol="label", numTrees=7, maxDepth=6, seed=1)),
        ("sum", GBTRegressor, dict(labelCol="label", maxIter=9, maxDepth=4, seed=1)),
        ("vote", RandomForestClassifier, dict(labelCol="class", numTrees=9, maxDepth=5, seed=1)),
        ("mean", RandomForestRegressor, dict(labelCol="label", numTrees=1, maxDepth=0, seed=1)),
    ],
)
def test_node_tables_predict_as_the_library(spark, points, kind, learner, settings):
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), learner(**settings)]).fit(points)
    own = model.transform(points).select("id", "prediction")
    again = trees.NodeModel(spark, model, kind).transform(points).select("id", "prediction")
    apart = trees.distance(own, again, ["id"], "prediction").collect()
    assert len(apart) == 300 and all(r.distance == 0.0 for r in apart)


def test_rows_that_no_node_tells_apart_walk_the_trees_once(spark, monkeypatch):
    """As many walks as there are sides of the thresholds and categories, however many rows; odd numbers included."""
    train = spark.range(400).selectExpr("id % 40 / 8D AS a", "double(id % 5) AS b", "if(id % 40 > 15, 1D, 0D) + if(id % 5 IN (1, 4), 3D, 0D) AS label")
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="both"), VectorIndexer(inputCol="both", outputCol="features", maxCategories=5)]
    model = Pipeline(stages=[*stages, RandomForestRegressor(labelCol="label", numTrees=4, maxDepth=3, seed=1)]).fit(train)
    odd = [0.0, -0.0, float("inf"), float("-inf"), float("nan")]
    asked = spark.range(3000).selectExpr("id", "id / 500D AS a", "double(id % 5) AS b").unionByName(
        spark.createDataFrame([(9000 + 5 * i + j, v, float(j)) for i, v in enumerate(odd) for j in range(5)], "id long, a double, b double")
    )
    asked = VectorAssembler(inputCols=["a", "b"], outputCol="both", handleInvalid="keep").transform(asked).drop("a", "b")
    applied = PipelineModel(model.stages[1:])
    walked = []
    monkeypatch.setattr(trees, "leaves_reached", lambda rows, *rest, own=trees.leaves_reached: (walked.append(rows.count()), own(rows, *rest))[1])
    nodes = trees.NodeModel(spark, applied, "mean")
    thresholds = nodes.nodes.where("feature = 0").select("threshold").distinct().count()
    apart = trees.distance(applied.transform(asked), nodes.transform(asked), ["id"], "prediction").collect()
    assert len(apart) == 3025 and all(r.distance == 0.0 for r in apart)
    assert thresholds > 0 and walked[0] <= (thresholds + 1) * 5


def test_importances_from_gains(spark, points):
    forest = RandomForestRegressor(labelCol="label", numTrees=8, maxDepth=5, seed=3)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), forest]).fit(points)
    found = {r.feature: r.importance for r in trees.importances_by_nodes(trees.node_table(spark, model)).collect()}
    assert found == {i: pytest.approx(v) for i, v in enumerate(model.stages[-1].featureImportances.toArray())}


def test_distance_sees_what_differs(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (None, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 2.5), (2, None), (4, 5.0), (None, 1.0)], "k int, v double")
    found = {r.k: r.distance for r in trees.distance(a, b, ["k"], "v").collect()}
    assert found == {1: 0.25, 2: 0.0, 3: None, 4: None, None: 0.0}


def test_segments_are_a_fixed_point(spark):
    draw = random.Random(9)
    rows = [(f"c{i}", draw.gauss(100 * (i % 3), 20), draw.gauss(5, 2), None if i % 50 == 0 else draw.random()) for i in range(300)]
    features = spark.createDataFrame(rows, "client_id string, total_price double, quantity double, mean_spend double")
    found = work_table(customers.segment_customers(features))
    rows = customers.usable(features)
    residuals = customers.segment_residuals(rows, found).agg(F.count("*").alias("n"), F.max("excess").alias("e"), F.max("drift").alias("d")).first()
    assert residuals.n == 300 and abs(residuals.e) < 1e-9 and residuals.d < 1e-9
    placed = found.join(rows, "client_id").groupBy("cluster").agg(F.avg("total_price").alias("m")).orderBy("cluster").collect()
    assert [r.cluster for r in placed] == [0, 1, 2] and [r.m for r in placed] == sorted(r.m for r in placed)
    # The certificate tells a wrong cluster and a wrong distance.
    swapped = found.withColumn("cluster", (F.col("cluster") + F.when(F.col("client_id") == "c1", 1).otherwise(0)) % 3)
    worst = customers.segment_residuals(rows, swapped).agg(F.max("excess"), F.max("drift")).first()
    assert worst[0] > 0.1 and worst[1] > 0.01
    assert customers.segment_customers(features.limit(0)).count() == 0


def test_versions_follow_the_data(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: str(tmp_path))
    fits = []

    def version(rows, *settings):
        def train():
            fits.append(rows.count())
            line = RandomForestRegressor(labelCol="v", numTrees=1, maxDepth=1)
            return Pipeline(stages=[VectorAssembler(inputCols=["k"], outputCol="features"), line]).fit(rows), None

        return store.versioned_model(rows, "test", train, *settings)

    rows = spark.createDataFrame([(float(i), float(i % 4)) for i in range(20)], "k double, v double")
    version(rows)
    version(rows.orderBy(F.desc("k")).repartition(3))  # the same rows in another order
    version(rows.withColumn("v", F.col("v") + 1e-9))  # a sum added in another order
    assert fits == [20]
    version(rows.union(rows.limit(1)))
    version(rows.withColumn("v", F.col("v") + 1))
    version(rows, "other settings")
    assert fits == [20, 21, 20, 20]
    assert not [p for p in (tmp_path / "emporia" / "models").iterdir() if p.name.count(".")]
