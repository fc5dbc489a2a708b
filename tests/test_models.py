from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emporia.operators import customers, location, sales_model
from emporia.sources.store import load_or_train, work_table

CATEGORIES, REGIONS = ["drinks", "food", "toys"], ["Beja", "Sfax", "Tunis"]


@pytest.fixture(scope="module")
def fact(spark):
    rows = [
        (c, "acme" if i % 2 else "best", f"{c} {i}", r, f"{r}-{i % 2}", f"2020-{m:02d}-{i % 28 + 1:02d}", float((k + 1) * (j + 2) * m), 2.0, 1.5)
        for k, c in enumerate(CATEGORIES)
        for j, r in enumerate(REGIONS)
        for m in range(1, 13)
        for i in range(3)
        if not (c == "toys" and r == "Beja")
    ]
    schema = (
        "category string, brand string, product_name string, delegation string, locality string, "
        "purchase_date string, total_price double, quantity double, unit_price double"
    )
    return work_table(spark.createDataFrame(rows, schema).withColumn("purchase_date", F.to_date("purchase_date")))


@pytest.fixture(scope="module")
def cells(fact):
    return work_table(location.category_region_revenue(fact))


@pytest.fixture(scope="module")
def sales(fact):
    return sales_model.sales_model_v2(fact, trees=5)


def test_means_and_factors(cells):
    values = {(r.category, r.region): r.revenue for r in cells.collect()}
    means = {(r.kind, r.key): r.mean_revenue for r in location.location_means(cells).collect()}
    assert len(means) == 7 and means[("global", None)] == pytest.approx(sum(values.values()) / 8)
    assert means[("category", "toys")] == pytest.approx((values[("toys", "Sfax")] + values[("toys", "Tunis")]) / 2)
    factors = {r.region: r.factor for r in location.region_factor(cells).collect()}
    assert sum(factors.values()) == pytest.approx(3)


def test_region_fallbacks(spark, cells):
    asked = spark.createDataFrame([("toys",), ("books",)], "category string")
    found = {(r.category, r.region): (r.predicted, r.is_known) for r in location.predict_region_revenue(cells, asked).collect()}
    values = {(r.category, r.region): r.revenue for r in cells.collect()}
    factors = {r.region: r.factor for r in location.region_factor(cells).collect()}
    toys = (values[("toys", "Sfax")] + values[("toys", "Tunis")]) / 2
    assert found[("toys", "Sfax")] == (pytest.approx(values[("toys", "Sfax")]), True)
    assert found[("toys", "Beja")] == (pytest.approx(toys * factors["Beja"]), True)
    assert found[("books", "Tunis")] == (pytest.approx(sum(values.values()) / 8 * factors["Tunis"]), False)


def test_ranked_regions(spark, fact, cells):
    requests = spark.createDataFrame(
        [("DRINKS", " ACM ", None, 2), ("toys", "", "toys 2", 3), ("toys", "nobody", "toys", 1), ("food", "best", "9", 1), (None, "", "", 3)],
        "category string, brand string, product_name string, top_n int",
    )
    rows = location.rank_regions(location.region_detail(fact), requests, cells).collect()
    of = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        of.setdefault((r.category, r.brand, r.product_name), []).append(r)
    acme = of[("drinks", "ACM", "")]
    assert [r.region for r in acme] == ["Tunis", "Sfax"] and all(r.filter_applied for r in acme)
    assert acme[0].predicted_revenue == 4 * 78.0 and acme[0].score == 100.0 and acme[1].confidence == "Élevée"
    toys = {r.region: r.predicted_revenue for r in of[("toys", "", "toys 2")]}
    fallback = {r.region: r.predicted for r in location.predict_region_revenue(cells, requests.select(F.lit("toys").alias("category"))).collect()}
    assert toys["Tunis"] == 3 * 4 * 78.0 and toys["Beja"] == pytest.approx(0.1 * fallback["Beja"], abs=0.01)
    assert (of[("toys", "nobody", "toys")][0].missing, of[("toys", "nobody", "toys")][0].filter_applied) == ("brand", False)
    assert of[("food", "best", "9")][0].missing == "product_name"
    assert len(of[("drinks", "", "")]) == 3


def test_location_model_blends(cells):
    made = location.train_location_model(cells, trees=5)
    found = location.predict_region_revenue(cells, cells, made.model)
    both = found.join(cells, ["category", "region"]).collect()
    assert len(both) == 8
    scored = {(r.category, r.region): r.prediction for r in made.model.transform(location.cell_features(cells)).collect()}
    for r in both:
        assert r.predicted == pytest.approx(0.6 * r.revenue + 0.4 * scored[(r.category, r.region)])
    assert made.metrics.count() == 1


def test_location_verdicts(spark):
    rows = [(float(y), float(y) + e, t) for t, e in ((True, 0.0), (False, 1.0)) for y in (10, 20, 30, 40)]
    row = location.location_metrics(spark.createDataFrame(rows, "revenue double, prediction double, is_train boolean")).first()
    assert (row.r2_train, row.overfit_status, row.interpretation) == (1.0, "fine", "excellent")
    assert (row.train_size, row.test_size, row.mae) == (4, 4, 1.0)


def test_regression_metrics_leave_zero_out_of_mape(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 9.0)], "revenue double, prediction double")
    row = sales_model.regression_metrics(df).first()
    assert (row.mape, row.mae, row.rmse, row.r2) == (pytest.approx(10.0), 1.0, 1.0, pytest.approx(1 - 1 / 25))


def test_sales_model_metrics_and_importance(sales):
    assert {r.part for r in sales.metrics.collect()} == {"train", "test"}
    importance = sales.importance.collect()
    assert sum(r.importance for r in importance) == pytest.approx(1.0)
    assert [r.importance for r in importance] == sorted((r.importance for r in importance), reverse=True)
    assert any("toys" in r.feature for r in importance)


def test_sales_predictions(spark, sales):
    requests = spark.createDataFrame(
        [("food", "Sfax", "Sfax-0", None), ("food", "Sfax", "Sfax-0", 6), ("unseen", None, None, 6)],
        "category string, delegation string, locality string, month int",
    )
    rows = {(r.category, r.month): r for r in sales_model.predict_sales(requests, sales.model).collect()}
    year = rows[("food", None)]
    assert [m.month for m in year.by_month] == list(range(1, 13)) and year.period_type == "year"
    assert year.predicted_revenue == pytest.approx(sum(m.revenue for m in year.by_month), abs=0.1)
    assert rows[("food", 6)].predicted_revenue == year.by_month[5].revenue
    assert rows[("unseen", 6)].delegation == "Tunis" and rows[("unseen", 6)].by_month is None
    totals = sales_model.total_prediction(sales_model.predict_sales(requests, sales.model))
    assert totals.agg(F.sum("category_count")).first()[0] == 3


def test_unseen_values_are_all_zeros(spark, sales):
    asked = spark.createDataFrame([("unseen", "nowhere", "none", 1)], "category string, delegation string, locality string, month int")
    features = sales.model.transform(asked).first().features.toArray()
    assert all(v == 0 for v in features[1:])


@pytest.mark.parametrize("kind", ["RandomForest", "GradientBoosting", "Ridge", "other"])
def test_learner_choice(fact, kind):
    made = sales_model.sales_model_select(fact, kind, trees=3, rounds=3)
    assert made.metrics.count() == 2 and (made.importance is None) == (kind == "Ridge")


def test_cross_validation(fact):
    row = sales_model.cross_validate(sales_model.sales_features_v2(fact), "Ridge", folds=3).first()
    assert row.folds == 3 and 0 < row.r2_mean <= 1 and row.r2_std >= 0


def test_models_are_saved_and_loaded(spark, sales, tmp_path):
    calls = []

    def train():
        calls.append(1)
        return sales.model, sales.metrics

    path = str(tmp_path / "model")
    load_or_train(spark, path, train)
    model, metrics = load_or_train(spark, path, train)
    assert calls == [1] and metrics.count() == 2
    asked = spark.createDataFrame([("food", "Sfax", "Sfax-0", 6)], "category string, delegation string, locality string, month int")
    assert sales_model.predict_sales(asked, model).first() == sales_model.predict_sales(asked, sales.model).first()


@pytest.fixture(scope="module")
def features(spark):
    rows = [(f"c{i}", float(i * 10), float(i % 5 + 1), i * 10 / (i % 5 + 1), int(i > 50)) for i in range(101)]
    rows.append(("none", 5.0, 0.0, None, 0))
    return spark.createDataFrame(rows, "client_id string, total_price double, quantity double, mean_spend double, high_value int")


def test_high_value(spark, features):
    made = customers.high_value_classifier(features, trees=10)
    assert made.metrics.first().accuracy > 0.85
    requests = spark.createDataFrame([(900.0, 3), (10.0, 0)], "total double, qty int")
    found = customers.predict_high_value(requests, made.model).collect()
    assert [(r.total, r.prediction) for r in found] == [(900.0, 1), (10.0, 0)]


def test_segments_cover_all_clients(features):
    rows = customers.segment_customers(features).collect()
    assert len(rows) == 102 and len({r.cluster for r in rows}) == 3


def test_ridge_is_the_closed_form(spark):
    """The learner adds α · |w|² with α = 1 to the sum of squares, the intercept being free."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    from emporia.operators import sales_model

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3)) * [1.0, 5.0, 0.2]
    y = x @ [3.0, -1.0, 8.0] + 100 + rng.normal(size=40)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, revenue double")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = sales_model.regressor("Ridge", 1, 1, 0, *sales_model.size_and_spread(rows)).fit(rows)
    centred = x - x.mean(axis=0)
    expected = np.linalg.solve(centred.T @ centred + np.eye(3), centred.T @ (y - y.mean()))
    assert model.coefficients.toArray() == pytest.approx(expected, rel=1e-6)


def test_model_without_metrics_and_half_written(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from emporia.sources import store

    model = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])
    whole, half = str(tmp_path / "whole"), str(tmp_path / "half")
    store.save_model(model, None, whole)
    assert store.model_exists(spark, whole) and store.load_model(spark, whole)[1] is None
    model.write().save(f"{half}/model")
    assert not store.model_exists(spark, half)
    assert store.load_or_train(spark, half, lambda: (model, spark.range(2)))[1].count() == 2


def test_run_folder_goes_with_its_block(spark):
    import os

    from emporia.sources import store

    with store.run_folder(spark) as path:
        assert work_table(spark.range(3)).count() == 3
        here = path.removeprefix("file:")
        assert os.listdir(here)
    assert not os.path.exists(here)
    assert store.scratch_path(spark).rsplit("/", 1)[0] != path
