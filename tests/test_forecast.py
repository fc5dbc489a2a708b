from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from emporia.operators import forecast


def month(i):
    return dt.date(2018 + i // 12, i % 12 + 1, 1)


def seasonal(i):
    return (100 + 2 * i) * (1.5 if i % 12 == 11 else 1.0)


@pytest.fixture(scope="module")
def series(spark):
    rows = [("grow", month(i), seasonal(i)) for i in range(48)]
    rows += [("flat", month(i), 10.0) for i in range(30)] + [("short", month(i), float(i)) for i in range(2)]
    return spark.createDataFrame(rows, "series_key string, ds date, y double")


def by_key(df, value):
    out: dict = {}
    for r in df.orderBy("series_key", "ds").collect():
        out.setdefault(r.series_key, []).append(r[value])
    return out


def test_lags_and_split(series):
    lagged = forecast.calendar_lag_features(series)
    assert {k: len(v) for k, v in by_key(lagged, "y").items()} == {"grow": 45, "flat": 27}
    first = lagged.where("series_key = 'grow'").orderBy("ds").first()
    assert (first.lag1, first.lag2, first.lag3) == (seasonal(2), seasonal(1), seasonal(0))
    assert (first.month, first.year, first.quarter) == (4, 2018, 2)
    train = by_key(forecast.chrono_split(series), "is_train")
    assert [sum(v) for v in train.values()] == [24, 38, 1]


def test_smoothing(series):
    smooth = by_key(forecast.smooth3(series), "y")
    assert smooth["short"] == [0.0, 0.5]
    assert smooth["grow"][5] == pytest.approx(sum(seasonal(i) for i in (3, 4, 5)) / 3)


def test_seasonal_forecast_follows_trend(series):
    found = by_key(forecast.forecast_seasonal(series, 6), "yhat")
    assert found["flat"] == pytest.approx([10.0] * 6)
    assert all(value >= 0 for values in found.values() for value in values)
    assert 150 < found["grow"][3] < 260
    dates = by_key(forecast.forecast_seasonal(series, 2), "ds")
    assert dates["short"] == [month(2), month(3)]


def test_metrics_agree_with_a_recomputation(series):
    holdout = forecast.seasonal_holdout(series).where("series_key = 'grow'")
    rows = holdout.collect()
    metrics = forecast.forecast_metrics(holdout).first()
    errors = [r.y - r.yhat for r in rows]
    mean = sum(r.y for r in rows) / len(rows)
    assert metrics.row_count == len(rows) == 10
    assert metrics.mae == pytest.approx(sum(map(abs, errors)) / 10)
    assert metrics.rmse == pytest.approx(math.sqrt(sum(e * e for e in errors) / 10))
    assert metrics.r2 == pytest.approx(1 - sum(e * e for e in errors) / sum((r.y - mean) ** 2 for r in rows))


def test_r2_needs_two_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "series_key string, y double, yhat double")
    assert forecast.forecast_metrics(df).first().r2 is None


def test_boosted_forecast(series):
    model, metrics = forecast.train_boosted(series, rounds=5, rate=0.5)
    assert {r.series_key for r in metrics.collect()} == {"grow", "flat"}
    found = by_key(forecast.forecast_recursive(series, model, 4), "yhat")
    assert set(found) == {"grow", "flat", "short"} and all(len(v) == 4 for v in found.values())
    assert all(v >= 0 for values in found.values() for v in values)
    assert found["flat"] == pytest.approx([10.0] * 4, rel=0.25)


def test_recursive_forecast_feeds_itself(spark, series):
    """With a model that returns lag1 + 1, in units of the series mean, steps add up."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    step = SQLTransformer(statement="SELECT *, lag1 + 1D AS prediction, 0 AS features FROM __THIS__")
    flat = series.where("series_key = 'flat'")
    found = by_key(forecast.forecast_recursive(flat, PipelineModel([step]), 3), "yhat")
    assert found["flat"] == [20.0, 30.0, 40.0]


def test_no_number_of_months_raises(spark):
    for months in range(16):
        rows = [("lait", month(i), 10.0 + i % 3) for i in range(months)]
        fact = spark.createDataFrame(rows, "product_name string, purchase_date date, revenue double")
        for found in (forecast.forecast_product(fact, "lait", rounds=2), forecast.forecast_total(fact, 3, rounds=2)):
            got = found.collect()
            assert [r.error is None for r in got] == ([True] * 3 if months >= 13 else [False])


def test_product_errors(spark):
    fact = spark.createDataFrame(
        [("lait", month(0), 1.0)], "product_name string, purchase_date date, revenue double"
    )
    assert forecast.forecast_product(fact, "pain").first().error == "product not found"
    assert forecast.forecast_product(fact, "LAI").first().error == "not enough data"


def test_demand_levels(spark):
    df = spark.createDataFrame([("a", y) for y in (100.0, 71.0, 70.0, 41.0, 40.0)], "series_key string, yhat double")
    levels = [r.level for r in forecast.demand_level(df).orderBy(F.desc("yhat")).collect()]
    assert levels == ["Forte demande"] * 2 + ["Demande modérée"] * 2 + ["Faible demande"]
    small = spark.createDataFrame([("a", 0.2)], "series_key string, yhat double")
    assert forecast.demand_level(small).first().percent == pytest.approx(20.0)
