"""Monthly forecasts for every series at once.

A series table has (series_key, ds, y) with one row per month, as `monthly_series` gives it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emporia.operators.kpi import monthly_series
from emporia.operators.lookup import filter_product
from emporia.sources.store import work_table

# Settings of the boosted trees and the least number of usable months.
ROUNDS, RATE, DEPTH, SUBSAMPLE = 300, 0.05, 5, 0.8
MIN_LAGGED_ROWS, MIN_MONTHS, TRAIN_SHARE = 10, 3, 0.8
# Demand levels, in percent of the highest forecast.
HIGH_DEMAND, MODERATE_DEMAND = 70, 40
HIGH_LABEL, MODERATE_LABEL, LOW_LABEL = "Forte demande", "Demande modérée", "Faible demande"
# The inputs of the boosted trees.
FEATURES = ["month", "year", "quarter", "lag1", "lag2", "lag3"]
LAGS = ["lag1", "lag2", "lag3"]


class Boosted(NamedTuple):
    model: PipelineModel
    metrics: DataFrame


def over_time():
    return W.partitionBy("series_key").orderBy("ds")


def whole_series():
    return W.partitionBy("series_key")


def calendar_parts(date: Column) -> dict[str, Column]:
    return {"month": F.month(date), "year": F.year(date), "quarter": F.quarter(date)}


def calendar_lag_features(series: DataFrame) -> DataFrame:
    """Calendar parts and the three previous values; months without three are dropped."""
    lags = {f"lag{k}": F.lag("y", k).over(over_time()) for k in (1, 2, 3)}
    return series.withColumns({**calendar_parts(F.col("ds")), **lags}).dropna(subset=[*LAGS, "y"])


def chrono_split(df: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    """Mark the first int(share · n) months of each series as `is_train`."""
    place = F.row_number().over(over_time())
    n = F.count("*").over(whole_series())
    return df.withColumn("is_train", place <= F.floor(n * F.lit(share)))


def smooth3(series: DataFrame) -> DataFrame:
    """Replace y by the mean of the month and up to two before it."""
    return series.withColumn("y", F.avg("y").over(over_time().rowsBetween(-2, 0)))


def forecast_metrics(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """MAE, RMSE and R² of `yhat` against `y` per series; R² needs two rows that differ."""
    keys = ["series_key"] if keys is None else keys
    error = F.col("y") - F.col("yhat")
    return (
        scored.groupBy(*keys)
        .agg(
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error * error).alias("_mse"),
            F.var_pop("y").alias("_var"),
            F.count("*").alias("row_count"),
        )
        .select(
            *keys,
            "row_count",
            "mae",
            F.sqrt("_mse").alias("rmse"),
            F.when((F.col("row_count") > 1) & (F.col("_var") > 0), 1 - F.col("_mse") / F.col("_var")).alias("r2"),
        )
    )


def fit_seasonal(series: DataFrame) -> DataFrame:
    """Per series: a straight trend and, per calendar month, the mean ratio of y to it.

    (series_key, n, last_ds, middle, level, slope, factors) where the trend at month t = 0, 1, …
    is level + slope · (t − middle) and `factors` maps a calendar month to its ratio. Months where
    the trend is not positive give no ratio. A series is as long as its calendar, so its rows fit
    one task; all series are fitted in parallel.
    """
    timed = (
        series.withColumn("t", F.row_number().over(over_time()) - 1)
        .withColumn("n", F.count("*").over(whole_series()))
        .withColumn("middle", (F.col("n") - 1) / 2)
        .withColumn("dt", F.col("t") - F.col("middle"))
        .withColumn("last_ds", F.max("ds").over(whole_series()))
        .withColumn("level", F.avg("y").over(whole_series()))
        .withColumn(
            "slope",
            F.coalesce(
                F.try_divide(
                    F.sum(F.col("dt") * F.col("y")).over(whole_series()),
                    F.sum(F.col("dt") * F.col("dt")).over(whole_series()),
                ),
                F.lit(0.0),
            ),
        )
        .withColumn("trend", F.col("level") + F.col("slope") * F.col("dt"))
    )
    ratio = F.when(F.col("trend") > 0, F.col("y") / F.col("trend"))
    fixed = ["series_key", "n", "last_ds", "middle", "level", "slope"]
    by_month = timed.groupBy(*fixed, F.month("ds").alias("month")).agg(F.avg(ratio).alias("factor"))
    entries = F.map_from_entries(F.collect_list(F.struct("month", "factor")))
    return by_month.groupBy(*fixed).agg(entries.alias("factors"))


def seasonal_value(t: Column, month: Column) -> Column:
    """Fitted value at month t, not below 0; a calendar month never seen has ratio 1."""
    trend = F.col("level") + F.col("slope") * (t - F.col("middle"))
    return F.greatest(trend * F.coalesce(F.try_element_at("factors", month), F.lit(1.0)), F.lit(0.0))


def forecast_seasonal(series: DataFrame, periods: int = 3) -> DataFrame:
    """(series_key, ds, yhat) for the months after the data, from the smoothed series."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(periods)))
    return (
        fit_seasonal(smooth3(series))
        .withColumn("step", steps)
        .withColumn("ds", F.add_months("last_ds", F.col("step")))
        .select(
            "series_key",
            "ds",
            seasonal_value(F.col("n") - 1 + F.col("step"), F.month("ds")).alias("yhat"),
        )
    )


def seasonal_holdout(series: DataFrame) -> DataFrame:
    """(series_key, ds, y, yhat) on the last fifth, fitted on the months before it."""
    split = chrono_split(smooth3(series)).withColumn("t", F.row_number().over(over_time()) - 1)
    fitted = fit_seasonal(split.where("is_train").select("series_key", "ds", "y"))
    return (
        split.where("NOT is_train")
        .join(fitted, "series_key")
        .select("series_key", "ds", "y", seasonal_value(F.col("t"), F.month("ds")).alias("yhat"))
    )


def with_scale(series: DataFrame) -> DataFrame:
    """Add `scale`: the mean of the series' first four fifths, which training may know; 1 if not positive."""
    mean = F.avg(F.when(F.col("is_train"), F.col("y"))).over(whole_series())
    return chrono_split(series).withColumn("scale", F.when(mean > 0, mean).otherwise(1.0)).drop("is_train")


def long_enough(series: DataFrame) -> bool:
    """True if a series has enough months to train on: MIN_LAGGED_ROWS with three before them."""
    lagged = calendar_lag_features(series).groupBy("series_key").count()
    return not lagged.where(F.col("count") >= MIN_LAGGED_ROWS).isEmpty()


def training_rows(series: DataFrame) -> DataFrame:
    """Lagged months of the series that are long enough, in units of their scale, the first ones `is_train`."""
    lagged = calendar_lag_features(with_scale(series)).withColumn("_n", F.count("*").over(whole_series()))
    scaled = chrono_split(lagged.where(F.col("_n") >= MIN_LAGGED_ROWS).drop("_n"))
    relative = {c: F.col(c) / F.col("scale") for c in LAGS}
    return work_table(scaled.withColumns(relative).withColumn("label", F.col("y") / F.col("scale")))


def holdout_metrics(rows: DataFrame, model) -> DataFrame:
    """Errors of a model on the last months of `training_rows`, in each series' own unit."""
    scored = model.transform(rows.where("NOT is_train"))
    return forecast_metrics(scored.withColumn("yhat", F.col("prediction") * F.col("scale")))


def train_boosted(
    series: DataFrame,
    rounds: int = ROUNDS,
    rate: float = RATE,
    depth: int = DEPTH,
    subsample: float = SUBSAMPLE,
    seed: int = 42,
) -> Boosted:
    """One boosted-tree model over the training months of all series that are long enough.

    Values are divided by the scale of their series, so that series of different size share a model.
    Metrics are on the last fifth, per series and in its own unit. It raises without a series that
    is long enough; see `long_enough`.
    """
    rows = training_rows(series)
    trees = GBTRegressor(
        featuresCol="features", labelCol="label", predictionCol="prediction",
        maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample,
        featureSubsetStrategy=str(subsample), checkpointInterval=10, seed=seed,
    )
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = assembler.transform(rows.where("is_train"))
    model = PipelineModel([assembler, trees.fit(train)])
    return Boosted(model, holdout_metrics(rows, model))


def forecast_recursive(series: DataFrame, model: PipelineModel, periods: int = 3) -> DataFrame:
    """(series_key, ds, yhat), each step taking the earlier forecasts as its lags.

    A series is one row that gains one column per step, so there is no join and no growing
    lineage; missing lags of a short series are 0.
    """
    state = (
        with_scale(series)
        .withColumn("_back", F.row_number().over(W.partitionBy("series_key").orderBy(F.desc("ds"))))
        .groupBy("series_key")
        .agg(
            F.max("ds").alias("last_ds"),
            F.first("scale").alias("scale"),
            *[
                F.coalesce(F.max(F.when(F.col("_back") == k, F.col("y"))), F.lit(0.0)).alias(f"lag{k}")
                for k in (1, 2, 3)
            ],
        )
        .withColumns({c: F.col(c) / F.col("scale") for c in LAGS})
    )
    for step in range(1, periods + 1):
        when = F.add_months("last_ds", step)
        scored = model.transform(state.withColumns(calendar_parts(when)))
        state = (
            scored.withColumn(f"y{step}", F.greatest("prediction", F.lit(0.0)))
            .withColumns({"lag1": F.col(f"y{step}"), "lag2": F.col("lag1"), "lag3": F.col("lag2")})
            .drop("features", "prediction")
        )
    steps = F.array(
        *[
            F.struct(
                F.add_months("last_ds", k).alias("ds"), (F.col(f"y{k}") * F.col("scale")).alias("yhat")
            )
            for k in range(1, periods + 1)
        ]
    )
    return state.select("series_key", F.inline(steps))


def forecast_total(fact: DataFrame, periods: int = 6, **settings) -> DataFrame:
    """(series_key, ds, yhat, error): forecast of the whole business, or one row with only `error`."""
    return _trained_forecast(work_table(monthly_series(fact)), periods, settings)


def forecast_product(
    fact: DataFrame, name: str, periods: int = 3, exact: bool = False, **settings
) -> DataFrame:
    """Forecast of the sum over the products whose name contains `name`, or is it if `exact`.

    (ds, yhat, error): one row with only `error` when nothing matches or there are too few months.
    """
    series = work_table(monthly_series(filter_product(fact, name, exact)))
    return _trained_forecast(series, periods, settings, "product not found").drop("series_key")


def _trained_forecast(series: DataFrame, periods: int, settings: dict, absent: str = "not enough data") -> DataFrame:
    if not long_enough(series):
        reason = absent if series.isEmpty() else "not enough data"
        return series.sparkSession.sql(
            "SELECT CAST(NULL AS STRING) AS series_key, CAST(NULL AS DATE) AS ds, CAST(NULL AS DOUBLE) AS yhat, "
            f"'{reason}' AS error"
        )
    model = train_boosted(series, **settings).model
    return forecast_recursive(series, model, periods).withColumn("error", F.lit(None).cast("string"))


def demand_level(forecast: DataFrame) -> DataFrame:
    """Percent of the series' highest forecast and its demand level."""
    highest = F.greatest(F.max("yhat").over(whole_series()), F.lit(1.0))
    percent = F.col("percent")
    return forecast.withColumn("percent", 100 * F.col("yhat") / highest).withColumn(
        "level",
        F.when(percent > HIGH_DEMAND, HIGH_LABEL)
        .when(percent > MODERATE_DEMAND, MODERATE_LABEL)
        .otherwise(LOW_LABEL),
    )


def stock_advice(fact: DataFrame, periods: int = 3) -> DataFrame:
    """Products whose last forecast monthly quantity exceeds their mean quantity per purchase.

    The two figures have different units; the rule is kept as it is.
    """
    forecast = forecast_seasonal(monthly_series(fact, "product_name", "quantity"), periods)
    last = forecast.groupBy("series_key").agg(F.max_by("yhat", "ds").alias("predicted_demand"))
    stock = (
        fact.where("product_name IS NOT NULL")
        .groupBy(F.col("product_name").alias("series_key"))
        .agg(F.avg("quantity").alias("current_stock"))
    )
    return (
        last.join(stock, "series_key")
        .where("predicted_demand > current_stock")
        .select(
            F.col("series_key").alias("product_name"), "predicted_demand", "current_stock",
            F.lit("BUY MORE").alias("action"),
        )
    )
