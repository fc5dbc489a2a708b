"""Revenue regression by category, place and month."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporia.operators import validation
from emporia.operators.splits import in_training
from emporia.sources.store import work_table

PLACE = ["category", "delegation", "locality"]
# Model settings, place used when none is asked for, folds.
TREES_V2, TREES_V1, DEPTH, LEAF = 200, 100, 15, 2
BOOST_ROUNDS, BOOST_RATE, BOOST_DEPTH, RIDGE_ALPHA = 100, 0.1, 5, 1.0
DEFAULT_PLACE, FOLDS = "Tunis", 5


class SalesModel(NamedTuple):
    model: PipelineModel
    metrics: DataFrame
    importance: DataFrame | None


def sales_features_v2(fact: DataFrame) -> DataFrame:
    """Σ price per category, place and calendar month (years pooled)."""
    return (
        fact.dropna(subset=["total_price", "purchase_date", *PLACE])
        .groupBy(*PLACE, F.month("purchase_date").alias("month"))
        .agg(F.sum("total_price").alias("revenue"))
    )


def sales_features_v1(fact: DataFrame) -> DataFrame:
    """As v2 per weekday (Monday = 0) too, with Σ quantity and mean unit price."""
    if "total_price" not in fact.columns:
        fact = fact.withColumn("total_price", F.col("unit_price") * F.col("quantity"))
    return (
        fact.dropna(subset=["purchase_date", *PLACE])
        .groupBy(*PLACE, F.month("purchase_date").alias("month"), F.weekday("purchase_date").alias("day_of_week"))
        .agg(
            F.sum("total_price").alias("revenue"),
            F.sum("quantity").alias("quantity"),
            # From a rounded sum, so that the mean does not depend on the order of adding.
            (F.round(F.sum("unit_price"), 4) / F.count("unit_price")).alias("mean_unit_price"),
        )
    )


def encoder_stages(numbers: list[str]) -> list:
    """Scale the numbers and one-hot the place columns.

    The indexer keeps a slot for unknown values and the encoder drops that last slot, so an
    unknown value is all zeros.
    """
    indexed = [f"{c}_index" for c in PLACE]
    encoded = [f"{c}_vec" for c in PLACE]
    return [
        StringIndexer(inputCols=PLACE, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=numbers, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled", *encoded], outputCol="features"),
    ]


def regressor(kind: str, trees: int, rounds: int, seed: int, rows: float = 1, spread: float = 1.0):
    """The learner by name; any other name gives a default forest.

    Ridge adds α · |w|² to the sum of squared errors of `rows` rows. Spark averages and halves
    the errors of a label that it divides by its `spread`, hence the factor.
    """
    common = {"featuresCol": "features", "labelCol": "revenue"}
    if kind == "RandomForest":
        return RandomForestRegressor(
            numTrees=trees, maxDepth=DEPTH, minInstancesPerNode=LEAF, featureSubsetStrategy="all",
            seed=seed, **common,
        )
    if kind == "GradientBoosting":
        return GBTRegressor(maxIter=rounds, stepSize=BOOST_RATE, maxDepth=BOOST_DEPTH, seed=seed, **common)
    if kind == "Ridge":
        return LinearRegression(
            elasticNetParam=0.0, regParam=RIDGE_ALPHA * spread / max(rows, 1), standardization=False, **common
        )
    return RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", seed=seed, **common)


def size_and_spread(rows: DataFrame) -> tuple[int, float]:
    """Number of rows and deviation of their revenue."""
    n, spread = rows.agg(F.count("*"), F.stddev_pop("revenue")).first()
    return n, spread or 1.0


def regression_metrics(
    scored: DataFrame, actual: str = "revenue", predicted: str = "prediction", keys: list[str] | None = None
) -> DataFrame:
    """R², MAE, RMSE and MAPE (in percent, rows with actual 0 left out)."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    relative = F.abs(F.try_divide(error, y))
    totals = scored.groupBy(*(keys or [])).agg(
        F.count("*").alias("row_count"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("_mse"),
        F.var_pop(y).alias("_var"),
        (F.avg(relative) * 100).alias("mape"),
    )
    return totals.select(
        *(keys or []),
        "row_count",
        (1 - F.try_divide("_mse", "_var")).alias("r2"),
        "mae",
        F.sqrt("_mse").alias("rmse"),
        "mape",
    )


def feature_importance(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """(feature, importance) of a tree model, largest first, named by the assembled columns."""
    attributes = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attributes.values() for a in group}
    values = model.stages[-1].featureImportances.toArray()
    rows = [(names.get(i, f"feature_{i}"), float(v)) for i, v in enumerate(values)]
    return scored.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def train_sales_model(
    features: DataFrame,
    kind: str = "RandomForest",
    trees: int = TREES_V1,
    rounds: int = BOOST_ROUNDS,
    seed: int = 42,
) -> SalesModel:
    """Fit on four fifths; metrics for both parts as rows (`part` = train or test)."""
    numbers = [c for c in ("month", "day_of_week") if c in features.columns]
    part = F.when(in_training([*PLACE, *numbers], seed), "train").otherwise("test")
    rows = work_table(features.select(*PLACE, *numbers, "revenue").withColumn("part", part))
    stages = [*encoder_stages(numbers), regressor(kind, trees, rounds, seed, *size_and_spread(rows.where("part = 'train'")))]
    model = Pipeline(stages=stages).fit(rows.where("part = 'train'"))
    scored = model.transform(rows)
    metrics = regression_metrics(scored, keys=["part"])
    has_importance = hasattr(model.stages[-1], "featureImportances")
    return SalesModel(model, metrics, feature_importance(model, scored) if has_importance else None)


def sales_model_v2(fact: DataFrame, trees: int = TREES_V2, seed: int = 42) -> SalesModel:
    return train_sales_model(sales_features_v2(fact), "RandomForest", trees, seed=seed)


def sales_model_select(
    fact: DataFrame, kind: str, trees: int = TREES_V1, rounds: int = BOOST_ROUNDS, seed: int = 42
) -> SalesModel:
    return train_sales_model(sales_features_v1(fact), kind, trees, rounds, seed)


def fold_scores(
    features: DataFrame,
    kind: str = "RandomForest",
    trees: int = TREES_V1,
    rounds: int = BOOST_ROUNDS,
    folds: int = FOLDS,
    seed: int = 42,
) -> DataFrame:
    """(fold, r2): every fold tested by a model of the other folds. A fold without rows has no row."""
    numbers = [c for c in ("month", "day_of_week") if c in features.columns]
    rows = validation.fold_rows(features, PLACE, numbers, folds, seed)
    if kind == "Ridge":
        return validation.ridge_folds(rows, PLACE, numbers, RIDGE_ALPHA, folds)
    if kind == "GradientBoosting":  # rounds depend on each other: one model per fold
        return validation.forest_folds(rows, PLACE, numbers, lambda n, part: regressor(kind, n, rounds, seed), 1, folds)
    return validation.forest_folds(rows, PLACE, numbers, lambda n, part: regressor(kind, n, rounds, seed + part), trees, folds)


def cross_validate(features: DataFrame, kind: str = "RandomForest", folds: int = FOLDS, **settings) -> DataFrame:
    """Mean and spread of R² over the folds, in one row; `settings` are those of `fold_scores`."""
    scores = fold_scores(features, kind, folds=folds, **settings)
    return scores.agg(F.lit(folds).alias("folds"), F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"))


def predict_sales(requests: DataFrame, model: PipelineModel) -> DataFrame:
    """Predicted revenue for (category, delegation, locality, month) requests.

    A request without month gives the sum of twelve monthly predictions and their list; a request
    without place, null or empty, means the default place. One row per distinct request.
    """
    asked = requests.select(*PLACE, "month").replace("", None, subset=["delegation", "locality"])
    filled = asked.fillna(DEFAULT_PLACE, subset=["delegation", "locality"]).distinct()
    monthly = filled.withColumnRenamed("month", "asked_month").withColumn(
        "month", F.explode(F.when(F.col("asked_month").isNull(), F.sequence(F.lit(1), F.lit(12))).otherwise(F.array("asked_month")))
    )
    detail = F.struct("month", F.round("prediction", 2).alias("revenue"))
    return (
        model.transform(monthly)
        .groupBy(*PLACE, "asked_month")
        .agg(
            F.round(F.sum("prediction"), 2).alias("predicted_revenue"),
            F.array_sort(F.collect_list(detail)).alias("by_month"),
        )
        .select(
            *PLACE,
            F.col("asked_month").alias("month"),
            "predicted_revenue",
            F.when(F.col("asked_month").isNull(), F.col("by_month")).alias("by_month"),
            F.when(F.col("asked_month").isNull(), "year").otherwise("month").alias("period_type"),
        )
    )


def total_prediction(predictions: DataFrame) -> DataFrame:
    """Sum over the requested categories per place and month."""
    return predictions.groupBy("delegation", "locality", "month", "period_type").agg(
        F.round(F.sum("predicted_revenue"), 2).alias("total_revenue"),
        F.count("*").alias("category_count"),
    )
