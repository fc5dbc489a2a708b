"""Which regions to sell in."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emporia.functions.numbers import py_round
from emporia.functions.text import contains_join
from emporia.operators.lookup import resolve_category
from emporia.operators.sales_model import regression_metrics
from emporia.operators.splits import in_training
from emporia.sources.store import work_table

# Forest settings, blend of observed and predicted, discount of unseen regions.
TREES, DEPTH, LEAF = 60, 7, 3
OBSERVED_WEIGHT, MODEL_WEIGHT, UNSEEN_SHARE = 0.6, 0.4, 0.1
# Score bounds with their labels, fit bounds.
HIGH_SCORE, MEDIUM_SCORE = 75, 45
HIGH_LABEL, MEDIUM_LABEL, LOW_LABEL = "Élevée", "Moyenne", "Faible"
OVERFIT_GAP, SLIGHT_GAP = 0.15, 0.05
EXCELLENT_R2, EXCELLENT_MAPE, GOOD_R2, GOOD_MAPE, FAIR_R2 = 0.85, 20, 0.70, 35, 0.50

FEATURES = ["category_code", "region_code", "region_mean", "category_mean"]
# A request is identified by all its parts.
REQUEST = ["category", "brand", "product_name"]
DEFAULT_TOP = 5  # regions, for a request without a number


class LocationModel(NamedTuple):
    model: PipelineModel
    metrics: DataFrame


def money_sum(column: str) -> Column:
    """A sum at four decimals, so that it does not depend on the order of adding."""
    return F.round(F.sum(column), 4)


def exact_mean(column: str) -> Column:
    """A mean whose sum is exact, so that it does not depend on the order of adding."""
    return F.sum(F.col(column).cast("decimal(28,6)")).cast("double") / F.count(column)


def category_region_revenue(fact: DataFrame) -> DataFrame:
    """The cells: Σ price per category and region."""
    return (
        fact.dropna(subset=["total_price", "category", "delegation"])
        .groupBy("category", F.col("delegation").alias("region"))
        .agg(money_sum("total_price").alias("revenue"))
    )


def region_detail(fact: DataFrame) -> DataFrame:
    """Stored Σ price per category, brand, product name and region: all that requests need."""
    return work_table(
        fact.dropna(subset=["total_price", "category", "delegation"])
        .groupBy("category", "brand", "product_name", F.col("delegation").alias("region"))
        .agg(money_sum("total_price").alias("revenue"))
    )


def detail_cells(detail: DataFrame) -> DataFrame:
    """The cells, summed up from `region_detail` instead of the purchases."""
    return work_table(detail.groupBy("category", "region").agg(money_sum("revenue").alias("revenue")))


def location_means(cells: DataFrame) -> DataFrame:
    """(kind, key, mean_revenue): mean cell per region, per category and of all."""
    means = cells.groupingSets(
        [["region"], ["category"], []], "region", "category"
    ).agg(exact_mean("revenue").alias("mean_revenue"), F.grouping_id().alias("g"))
    # grouping_id marks the columns left out: 1 keeps the region, 2 the category, 3 neither.
    return means.select(
        F.when(F.col("g") == 1, "region").when(F.col("g") == 2, "category").otherwise("global").alias("kind"),
        F.coalesce("region", "category").alias("key"),
        "mean_revenue",
    )


def region_factor(cells: DataFrame) -> DataFrame:
    """Region mean over the mean of the region means."""
    regions = cells.groupBy("region").agg(exact_mean("revenue").alias("region_mean"))
    overall = regions.agg(exact_mean("region_mean")).scalar()
    factor = F.coalesce(F.try_divide(F.col("region_mean"), overall), F.lit(1.0))
    return regions.withColumn("factor", factor)


def cell_features(cells: DataFrame) -> DataFrame:
    regions = cells.groupBy("region").agg(exact_mean("revenue").alias("region_mean"))
    categories = cells.groupBy("category").agg(exact_mean("revenue").alias("category_mean"))
    return cells.join(regions, "region").join(categories, "category")


def train_location_model(cells: DataFrame, trees: int = TREES, seed: int = 42) -> LocationModel:
    """Random forest on (category code, region code, region mean, category mean)."""
    rows = work_table(
        cell_features(cells).withColumn("is_train", in_training(["category", "region"], seed))
    )
    stages = [
        StringIndexer(
            inputCols=["category", "region"], outputCols=["category_index", "region_index"],
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ),
        # The trees split on the codes as numbers, so their marking as categories is taken off.
        SQLTransformer(
            statement="SELECT *, category_index + 0D AS category_code, region_index + 0D AS region_code FROM __THIS__"
        ),
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        RandomForestRegressor(
            featuresCol="features", labelCol="revenue", numTrees=trees, maxDepth=DEPTH,
            minInstancesPerNode=LEAF, featureSubsetStrategy="all", seed=seed,
        ),
    ]
    model = Pipeline(stages=stages).fit(rows.where("is_train"))
    return LocationModel(model, location_metrics(model.transform(rows)))


def location_metrics(scored: DataFrame) -> DataFrame:
    """One row: R² of both parts, their gap, test MAE and MAPE, and two verdicts.

    `scored` has `revenue`, `prediction` and `is_train`.
    """
    parts = regression_metrics(scored, keys=["is_train"])

    def of(part: str, column: str) -> Column:
        return F.max(F.when(F.col("is_train") if part == "train" else ~F.col("is_train"), F.col(column)))

    gap, r2, mape = F.col("overfit_gap"), F.col("r2_test"), F.col("mape")
    return (
        parts.agg(
            of("train", "r2").alias("r2_train"),
            of("test", "r2").alias("r2_test"),
            of("test", "mae").alias("mae"),
            of("test", "mape").alias("mape"),
            of("train", "row_count").alias("train_size"),
            of("test", "row_count").alias("test_size"),
        )
        .withColumn("overfit_gap", F.col("r2_train") - F.col("r2_test"))
        .withColumn(
            "overfit_status",
            F.when(gap > OVERFIT_GAP, "overfit").when(gap > SLIGHT_GAP, "slight").otherwise("fine"),
        )
        .withColumn(
            "interpretation",
            F.when((r2 >= EXCELLENT_R2) & (mape <= EXCELLENT_MAPE), "excellent")
            .when((r2 >= GOOD_R2) & (mape <= GOOD_MAPE), "good")
            .when(r2 >= FAIR_R2, "acceptable")
            .otherwise("weak"),
        )
    )


def predict_region_revenue(
    cells: DataFrame, categories: DataFrame, model: PipelineModel | None = None
) -> DataFrame:
    """(category, region, predicted) for asked categories in every known region.

    A known cell is 0.6 observed + 0.4 model (or as observed without a model); a known category
    without the cell is its mean × the region factor; an unknown category is the mean of all
    cells × the region factor. `cells` are read several times, so pass a stored table.
    """
    category_means = cells.groupBy("category").agg(exact_mean("revenue").alias("category_mean"))
    everywhere = cells.agg(exact_mean("revenue")).scalar()
    # The list of regions is as short as a country's map; each asked category is answered for all.
    regions = region_factor(cells).agg(
        F.collect_list(F.struct("region", "region_mean", "factor"))
    ).scalar()
    grid = (
        categories.select("category").distinct()
        .join(category_means, "category", "left")
        .withColumn("_regions", regions)
        .select("category", "category_mean", F.inline("_regions"))
        .join(cells, ["category", "region"], "left")
    )
    observed, is_known = F.col("revenue"), F.col("category_mean").isNotNull()
    blended = observed
    if model is not None:
        grid = grid.withColumn("_mean", F.col("category_mean")).fillna(0.0, subset=["category_mean"])
        grid = model.transform(grid)
        is_known = F.col("_mean").isNotNull()
        blended = OBSERVED_WEIGHT * observed + MODEL_WEIGHT * F.col("prediction")
    return grid.select(
        "category",
        "region",
        F.when(observed.isNotNull(), blended)
        .when(is_known, F.col("category_mean") * F.col("factor"))
        .otherwise(everywhere * F.col("factor"))
        .alias("predicted"),
        is_known.alias("is_known"),
    )


def filter_region_stats(detail: DataFrame, requests: DataFrame) -> DataFrame:
    """Σ price per region over the category's purchases whose brand and name contain the asked texts.

    `detail` comes from `region_detail`. Requests are (category, brand, product_name), an empty text meaning "not asked". Each distinct
    request gives its regions; one without any match gives a single row with no region and
    `missing` naming the text that failed ("brand" or "product_name").
    """
    asked = work_table(
        requests.select(*REQUEST).where("brand <> '' OR product_name <> ''").distinct()
        .withColumn("_brand", F.lower("brand")).withColumn("_name", F.lower("product_name"))
    )
    detail = detail.withColumnsRenamed(
        {"brand": "_of_brand", "product_name": "_of_name", "revenue": "_revenue"}
    )
    brands = detail.select("_of_brand").distinct().withColumn("_low", F.lower("_of_brand"))
    names = detail.select("_of_name").distinct().withColumn("_low", F.lower("_of_name"))
    by_brand = contains_join(brands, "_low", asked.select("_brand").where("_brand <> ''").distinct(), "_brand")
    by_name = contains_join(
        names, "_low", asked.where("_brand = ''").select("_name").distinct(), "_name"
    )
    brand_rows = (
        asked.join(by_brand.drop("_low"), "_brand")
        .join(detail, ["category", "_of_brand"])
        .withColumn("_ok", (F.col("_name") == "") | F.contains(F.lower("_of_name"), F.col("_name")))
    )
    name_rows = (
        asked.where("_brand = ''")
        .join(by_name.drop("_low"), "_name")
        .join(detail, ["category", "_of_name"])
        .withColumn("_ok", F.lit(True))
    )
    columns = [*REQUEST, "region", "_revenue", "_ok"]
    matched = brand_rows.select(*columns).unionByName(name_rows.select(*columns))
    sums = work_table(
        matched.groupBy(*REQUEST, "region").agg(
            F.sum(F.when(F.col("_ok"), F.col("_revenue"))).alias("revenue")
        )
    )
    status = sums.groupBy(*REQUEST).agg(F.count("revenue").alias("_regions"))
    missing = (
        F.when(F.col("_regions") > 0, "")
        .when(F.col("_regions").isNull() & (F.col("brand") != ""), "brand")
        .otherwise("product_name")
    )
    return (
        asked.select(*REQUEST)
        .join(status, REQUEST, "left")
        .withColumn("missing", missing)
        .drop("_regions")
        .join(sums.where("revenue IS NOT NULL"), REQUEST, "left")
    )


def clean_requests(requests: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct requests with trimmed texts, the default number of regions and the category resolved."""
    blank = F.lit("")
    texts = {c: F.coalesce(F.trim(c), blank) for c in ("brand", "product_name")}
    asked = requests.select(*REQUEST, F.coalesce("top_n", F.lit(DEFAULT_TOP)).alias("top_n")).withColumns(texts)
    asked = asked.withColumn("category", F.coalesce("category", blank)).distinct()
    resolved = resolve_category(
        asked.select(F.col("category").alias("query")), categories
    ).withColumnRenamed("category", "resolved")
    return (
        asked.join(resolved, F.col("category") == F.col("query"))
        .select(F.col("resolved").alias("category"), "brand", "product_name", "top_n")
        .distinct()
    )


def rank_regions(
    detail: DataFrame, requests: DataFrame, cells: DataFrame | None = None, model: PipelineModel | None = None
) -> DataFrame:
    """The top_n regions for each distinct (category, brand, product_name, top_n) request.

    A region's value is the revenue matching the request; where there is none, a tenth of its
    prediction. A request without texts, or whose texts match nothing, is ranked by prediction.
    `detail` comes from `region_detail`; the purchases themselves are scanned once, for it.
    """
    cells = detail_cells(detail) if cells is None else cells
    asked = work_table(clean_requests(requests, cells))
    predicted = predict_region_revenue(cells, asked, model)
    stats = work_table(filter_region_stats(detail, asked))
    status = stats.select(*REQUEST, "missing").distinct()
    sums = stats.where("region IS NOT NULL").select(*REQUEST, "region", F.col("revenue").alias("_sum"))
    valued = (
        asked.join(predicted, "category")
        .join(status, REQUEST, "left")
        .join(sums, [*REQUEST, "region"], "left")
        .withColumn("filter_applied", F.coalesce(F.col("missing") == "", F.lit(False)))
        .withColumn(
            "value",
            F.when(~F.col("filter_applied"), F.col("predicted"))
            .when(F.coalesce("_sum", F.lit(0.0)) == 0, F.col("predicted") * UNSEEN_SHARE)
            .otherwise(F.col("_sum")),
        )
    )
    request = [*REQUEST, "top_n"]
    order = W.partitionBy(*request).orderBy(F.desc("value"), "region")
    ranked = valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_n"))
    best = F.max("value").over(W.partitionBy(*request))
    score = py_round(F.col("value") / F.when(best > 0, best).otherwise(1.0) * 100, 1)
    return ranked.withColumn("score", score).select(
        *request,
        "rank",
        "region",
        py_round(F.col("value"), 2).alias("predicted_revenue"),
        "score",
        F.when(F.col("score") >= HIGH_SCORE, HIGH_LABEL)
        .when(F.col("score") >= MEDIUM_SCORE, MEDIUM_LABEL)
        .otherwise(LOW_LABEL)
        .alias("confidence"),
        "is_known",
        "filter_applied",
        F.coalesce("missing", F.lit("")).alias("missing"),
    )
