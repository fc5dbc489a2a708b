from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporia.functions.numbers import py_round

from emporia.operators import customers, kpi, location, sales_model
from emporia.operators.splits import in_training
from emporia.operators.trees import NodeModel, distance, importances_by_nodes, node_table
from emporia.plans.registry import r, register, tidy
from emporia.plans.views import SALES
from emporia.sources.star import sales, table
from emporia.sources.store import load_model, save_model, scratch_path, versioned_model, work_table

PLACE_COLUMNS = ["category", "delegation", "locality", "purchase_date", "total_price"]

def mean(column: str) -> str:
    """The mean from an exact sum."""
    return f"(CAST(sum(CAST({column} AS DECIMAL(28, 6))) AS DOUBLE) / count({column}))"


CELLS = """cells AS (
  SELECT category, delegation AS region, round(sum(total_price), 4) AS revenue FROM sales
  WHERE category IS NOT NULL AND delegation IS NOT NULL AND total_price IS NOT NULL GROUP BY 1, 2
)"""


def cells(spark, folder):
    return location.category_region_revenue(sales(spark, folder, "category", "delegation", "total_price"))


@register(
    "category_region_revenue",
    f"WITH {SALES}, {CELLS} SELECT category, region, {r('revenue', 2)} AS revenue FROM cells",
)
def q_cells(spark, folder):
    return tidy(cells(spark, folder), 2)


@register(
    "location_means",
    f"""WITH {SALES}, {CELLS}
    SELECT 'region' AS kind, region AS key, {r(mean('revenue'))} AS mean_revenue FROM cells GROUP BY 2
    UNION ALL SELECT 'category', category, {r(mean('revenue'))} FROM cells GROUP BY 2
    UNION ALL SELECT 'global', NULL, {r(mean('revenue'))} FROM cells""",
)
def q_location_means(spark, folder):
    return tidy(location.location_means(cells(spark, folder)))


FACTORS = f"""regions AS (SELECT region, {mean('revenue')} AS region_mean FROM cells GROUP BY 1
), factors AS (
  SELECT region, region_mean, region_mean / (SELECT {mean('region_mean')} FROM regions) AS factor FROM regions
)"""


@register(
    "region_factor",
    f"""WITH {SALES}, {CELLS}, {FACTORS} SELECT region, {r('region_mean')} AS region_mean,
    {r('factor')} AS factor FROM factors""",
)
def q_region_factor(spark, folder):
    return tidy(location.region_factor(work_table(cells(spark, folder))))


@register(
    "predict_region_revenue",
    f"""WITH {SALES}, {CELLS}, {FACTORS}, asked AS (
      SELECT DISTINCT unnest([p_type, p_brand]) AS category FROM part
    ), means AS (SELECT category, {mean('revenue')} AS category_mean FROM cells GROUP BY 1)
    SELECT a.category, f.region, {r('''CASE WHEN c.revenue IS NOT NULL THEN c.revenue
      WHEN category_mean IS NOT NULL THEN category_mean * factor
      ELSE everywhere * factor END''', 2)} AS predicted, category_mean IS NOT NULL AS is_known
    FROM asked a CROSS JOIN factors f CROSS JOIN (SELECT {mean('revenue')} AS everywhere FROM cells) LEFT JOIN cells c
      ON c.category = a.category AND c.region = f.region
    LEFT JOIN means m ON m.category = a.category""",
)
def q_predict_region_revenue(spark, folder):
    """Without the model term; brands stand for unknown categories."""
    asked = table(spark, folder, "part").select(
        F.explode(F.array("p_type", "p_brand")).alias("category")
    )
    known = work_table(cells(spark, folder))
    return tidy(location.predict_region_revenue(known, asked), 2)


REQUEST_COLUMNS = ["category", "brand", "product_name", "delegation", "total_price"]


def location_requests(spark, folder):
    """Per part: its category with part of its brand, its last word, both, an absent brand, nothing."""
    word = F.split("p_name", " ")[1]
    nothing = F.lit("")

    def ask(category, brand, name, n):
        return F.struct(
            category.alias("category"), brand.alias("brand"), name.alias("product_name"), F.lit(n).alias("top_n")
        )

    kind, brand = F.col("p_type"), F.col("p_brand")
    short = F.concat(F.lit(" "), F.lower(brand))
    asks = F.array(
        ask(kind, short, nothing, 3), ask(F.lower(kind), nothing, word, 5), ask(kind, brand, word, 4),
        ask(kind, F.lit("nobody"), word, 2), ask(kind, brand, F.lit("nothing"), 2), ask(kind, nothing, nothing, 5),
        ask(F.concat(F.lit("?"), brand), nothing, nothing, 1),
    )
    return table(spark, folder, "part").select(F.inline(asks)).distinct()


REQUESTS = """requests AS (
  SELECT DISTINCT a.category, trim(a.brand) AS brand, a.product_name, a.top_n FROM (
    SELECT unnest([
      {'category': p_type, 'brand': lower(p_brand), 'product_name': '', 'top_n': 3},
      {'category': upper(p_type), 'brand': '', 'product_name': split_part(p_name, ' ', 2), 'top_n': 5},
      {'category': p_type, 'brand': p_brand, 'product_name': split_part(p_name, ' ', 2), 'top_n': 4},
      {'category': p_type, 'brand': 'nobody', 'product_name': split_part(p_name, ' ', 2), 'top_n': 2},
      {'category': p_type, 'brand': p_brand, 'product_name': 'nothing', 'top_n': 2},
      {'category': p_type, 'brand': '', 'product_name': '', 'top_n': 5},
      {'category': '?' || p_brand, 'brand': '', 'product_name': '', 'top_n': 1}]) AS a FROM part)
)"""

REGION_STATS = """asked AS (
  SELECT DISTINCT category, brand, product_name FROM requests WHERE brand <> '' OR product_name <> ''
), detail AS (
  SELECT category, brand AS b, product_name AS p, delegation AS region, sum(total_price) AS s FROM sales GROUP BY 1, 2, 3, 4
), hits AS (
  SELECT a.category, a.brand, a.product_name, d.region, d.s, contains(lower(d.p), lower(a.product_name)) AS ok
  FROM asked a JOIN detail d ON d.category = a.category AND contains(lower(d.b), lower(a.brand))
), sums AS (
  SELECT category, brand, product_name, region, sum(s) AS revenue FROM hits WHERE ok GROUP BY 1, 2, 3, 4
), states AS (
  SELECT a.category, a.brand, a.product_name, CASE WHEN coalesce(bool_or(ok), false) THEN ''
    WHEN a.brand <> '' AND count(ok) = 0 THEN 'brand' ELSE 'product_name' END AS missing
  FROM asked a LEFT JOIN hits h ON h.category = a.category AND h.brand = a.brand AND h.product_name = a.product_name
  GROUP BY a.category, a.brand, a.product_name
)"""


@register(
    "filter_region_stats",
    f"""WITH {SALES}, {REQUESTS}, {REGION_STATS} SELECT t.category, t.brand, t.product_name, t.missing, s.region,
    {r('s.revenue', 2)} AS revenue FROM states t LEFT JOIN sums s USING (category, brand, product_name)""",
)
def q_filter_region_stats(spark, folder):
    detail = location.region_detail(sales(spark, folder, *REQUEST_COLUMNS))
    asked = location.clean_requests(location_requests(spark, folder), detail)
    return tidy(location.filter_region_stats(detail, asked), 2)


@register(
    "rank_regions",
    f"""WITH {SALES}, {CELLS}, {FACTORS}, {REQUESTS}, {REGION_STATS},
    means AS (SELECT category, {mean('revenue')} AS category_mean FROM cells GROUP BY 1), valued AS (
      SELECT q.category, q.brand, q.product_name, q.top_n, f.region, category_mean IS NOT NULL AS is_known,
        coalesce(t.missing = '', false) AS filter_applied, coalesce(t.missing, '') AS missing,
        CASE WHEN t.missing = '' AND coalesce(s.revenue, 0) <> 0 THEN s.revenue
          ELSE CASE WHEN t.missing = '' THEN 0.1 ELSE 1.0 END * CASE WHEN c.revenue IS NOT NULL THEN c.revenue
            WHEN category_mean IS NOT NULL THEN category_mean * factor
            ELSE (SELECT {mean('revenue')} FROM cells) * factor END END AS value
      FROM requests q CROSS JOIN factors f
      LEFT JOIN cells c ON c.category = q.category AND c.region = f.region
      LEFT JOIN means m ON m.category = q.category
      LEFT JOIN states t ON t.category = q.category AND t.brand = q.brand AND t.product_name = q.product_name
      LEFT JOIN sums s ON s.category = q.category AND s.brand = q.brand AND s.product_name = q.product_name AND s.region = f.region
    ), ranked AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY category, brand, product_name, top_n ORDER BY value DESC, region) AS INTEGER) AS rank,
        max(value) OVER (PARTITION BY category, brand, product_name, top_n) AS best FROM valued QUALIFY rank <= top_n
    ), scored AS (
      SELECT *, {r('value / CASE WHEN best > 0 THEN best ELSE 1 END * 100', 1)} AS score FROM ranked)
    SELECT category, brand, product_name, top_n, rank, region, {r('value', 2)} AS predicted_revenue, score,
      CASE WHEN score >= 75 THEN 'Élevée' WHEN score >= 45 THEN 'Moyenne' ELSE 'Faible' END AS confidence,
      is_known, filter_applied, missing FROM scored""",
)
def q_rank_regions(spark, folder):
    """Without the model term."""
    detail = location.region_detail(sales(spark, folder, *REQUEST_COLUMNS))
    return location.rank_regions(detail, location_requests(spark, folder))


def fitted_location_model(spark, folder):
    known = work_table(cells(spark, folder))

    def train():
        made = location.train_location_model(known)
        return made.model, made.metrics

    return known, *versioned_model(known, "location", train)


@register("location_model")
def q_location_model(spark, folder):
    """Known cells as 0.6 observed + 0.4 model."""
    known, model, _ = fitted_location_model(spark, folder)
    return tidy(location.predict_region_revenue(known, known, model), 2)


@register(
    "location_model_residuals",
    f"WITH {SALES}, {CELLS} SELECT category, region, 0.0::DOUBLE AS distance FROM cells",
)
def q_location_model_residuals(spark, folder):
    """How far the predictions are from those of the node table, scored by joins, for every known cell."""
    known, model, _ = fitted_location_model(spark, folder)
    again = location.predict_region_revenue(known, known, NodeModel(spark, model, "mean"))
    own = location.predict_region_revenue(known, known, model)
    return distance(own, again, ["category", "region"], "predicted").join(known, ["category", "region"], "left_semi")


@register("location_metrics")
def q_location_metrics(spark, folder):
    return fitted_location_model(spark, folder)[2]


@register("rank_regions_with_model")
def q_rank_regions_with_model(spark, folder):
    detail = location.region_detail(sales(spark, folder, *REQUEST_COLUMNS))
    known = location.detail_cells(detail)
    model = versioned_model(known, "location-detail", lambda: location.train_location_model(known)[:2])[0]
    return location.rank_regions(detail, location_requests(spark, folder), known, model)


@register(
    "sales_features_v2",
    f"""WITH {SALES} SELECT category, delegation, locality, CAST(month(purchase_date) AS INTEGER) AS month,
    {r('sum(total_price)', 2)} AS revenue FROM sales GROUP BY 1, 2, 3, 4""",
)
def q_sales_features_v2(spark, folder):
    return tidy(sales_model.sales_features_v2(sales(spark, folder, *PLACE_COLUMNS)), 2)


@register(
    "sales_features_v1",
    f"""WITH {SALES} SELECT category, delegation, locality, CAST(month(purchase_date) AS INTEGER) AS month,
    CAST(isodow(purchase_date) - 1 AS INTEGER) AS day_of_week, {r('sum(total_price)', 6)} AS revenue,
    {r('sum(quantity)', 6)} AS quantity, {r('round(sum(unit_price), 4) / count(unit_price)', 6)} AS mean_unit_price FROM sales GROUP BY 1, 2, 3, 4, 5""",
)
def q_sales_features_v1(spark, folder):
    return tidy(sales_model.sales_features_v1(v1_fact(spark, folder)), 6)


def v1_fact(spark, folder):
    return sales(spark, folder, *PLACE_COLUMNS, "quantity", "unit_price")


@register(
    "regression_metrics",
    f"""WITH {SALES}, {CELLS}, scored AS (
      SELECT region, revenue AS y, avg(revenue) OVER (PARTITION BY category) AS yhat FROM cells)
    SELECT region, count(*) AS row_count, {r('1 - avg((y - yhat) * (y - yhat)) / nullif(var_pop(y), 0)')} AS r2,
      {r('avg(abs(y - yhat))', 2)} AS mae, {r('sqrt(avg((y - yhat) * (y - yhat)))', 2)} AS rmse,
      {r('avg(abs((y - yhat) / nullif(y, 0))) * 100')} AS mape FROM scored GROUP BY 1""",
)
def q_regression_metrics(spark, folder):
    """How well a category's mean predicts its cells, per region."""
    known = cells(spark, folder)
    means = known.groupBy("category").agg(F.avg("revenue").alias("prediction"))
    out = sales_model.regression_metrics(known.join(means, "category"), keys=["region"])
    digits = {"r2": 4, "mae": 2, "rmse": 2, "mape": 4}
    return out.withColumns({c: location.py_round(F.col(c), d) for c, d in digits.items()})


def fitted_sales_model(spark, folder):
    """The sales model of these tables and its metrics, from the model store if it has them."""
    rows = work_table(sales_model.sales_features_v2(sales(spark, folder, *PLACE_COLUMNS)))

    def train():
        made = sales_model.train_sales_model(rows, "RandomForest", sales_model.TREES_V2)
        return made.model, made.metrics

    return rows, *versioned_model(rows, "sales", train, sales_model.TREES_V2)


V2_ROWS = "SELECT DISTINCT category, delegation, locality, month(purchase_date) AS month FROM sales"


@register("sales_model_v2")
def q_sales_model_v2(spark, folder):
    """Metrics of the training and the test part."""
    return tidy(fitted_sales_model(spark, folder)[2])


@register(
    "sales_model_v2_residuals",
    f"""WITH {SALES}, rows AS ({V2_ROWS}), known AS (
      SELECT category, delegation, locality, month(purchase_date) AS month, sum(total_price) AS revenue FROM sales GROUP BY ALL)
    SELECT count(*) AS row_count, {r('sum(revenue)', 0)} AS revenue, 0.0::DOUBLE AS prediction_distance,
      0.0::DOUBLE AS metric_distance FROM known""",
)
def q_sales_model_v2_residuals(spark, folder):
    """Rows and revenue of both parts, and how far predictions and metrics are from a recomputation by nodes."""
    rows, model, metrics = fitted_sales_model(spark, folder)
    keys = [*sales_model.PLACE, "month"]
    again = work_table(NodeModel(spark, model, "mean").transform(rows))
    apart = distance(model.transform(rows), again, keys, "prediction").agg(F.max("distance").alias("prediction_distance"))
    part = F.when(in_training(keys), "train").otherwise("test")
    recomputed = sales_model.regression_metrics(again.withColumn("part", part), keys=["part"])
    off = [distance(metrics, recomputed, ["part"], c) for c in ("row_count", "r2", "mae", "rmse", "mape")]
    worst = functools.reduce(DataFrame.unionByName, off).agg(F.max(F.coalesce("distance", F.lit(9e9))).alias("metric_distance"))
    totals = rows.agg(F.count("*").alias("row_count"), py_round(F.sum("revenue"), 0).alias("revenue"))
    return totals.withColumns({"prediction_distance": apart.scalar(), "metric_distance": worst.scalar()})


@register("feature_importance")
def q_feature_importance(spark, folder):
    """(feature, importance), a row for each."""
    rows, model, _ = fitted_sales_model(spark, folder)
    return sales_model.feature_importance(model, model.transform(rows.limit(0)))


@register(
    "feature_importance_residuals",
    f"""WITH {SALES}, v AS (SELECT unnest(['category', 'delegation', 'locality']) AS c, unnest([category, delegation, locality]) AS x FROM sales)
    SELECT DISTINCT c || '_vec_' || x AS feature, 0.0::DOUBLE AS distance FROM v UNION ALL SELECT 'scaled_0', 0.0""",
)
def q_feature_importance_residuals(spark, folder):
    """How far every feature's importance is from the gains of the nodes that split on it."""
    rows, model, _ = fitted_sales_model(spark, folder)
    scored = model.transform(rows.limit(0))
    attributes = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = [(a["idx"], a["name"]) for group in attributes.values() for a in group]
    named = spark.createDataFrame(names, "feature_number int, feature string")
    gains = importances_by_nodes(node_table(spark, model)).withColumnRenamed("feature", "feature_number")
    again = named.join(gains, "feature_number", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return distance(sales_model.feature_importance(model, scored), again, ["feature"], "importance")


@register("sales_model_select")
def q_sales_model_select(spark, folder):
    """Hold-out metrics of the three learners."""
    fact = v1_fact(spark, folder)
    tables = [
        sales_model.sales_model_select(fact, kind).metrics.withColumn("kind", F.lit(kind))
        for kind in ("RandomForest", "GradientBoosting", "Ridge")
    ]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@register("cross_validate")
def q_cross_validate(spark, folder):
    """Ridge and the default forest."""
    rows = work_table(sales_model.sales_features_v1(v1_fact(spark, folder)))
    ridge, forest = [
        sales_model.cross_validate(rows, kind).withColumn("kind", F.lit(kind)) for kind in ("Ridge", "RandomForest")
    ]
    return ridge.unionByName(forest)


def sales_requests(spark, folder):
    """Each category and an unknown one (a brand) in its customer's place: one month, and the year."""
    places = sales(spark, folder, "category", "brand", "delegation", "locality").distinct()
    kinds = F.explode(F.array("category", "brand")).alias("category")
    months = F.array(F.lit(None).cast("int"), F.lit(7))
    return places.select(kinds, "delegation", "locality").select(
        "*", F.explode(months).alias("month")
    )


ASKED_SALES = """asked AS (
  SELECT DISTINCT category, delegation, locality, month, CASE WHEN month IS NULL THEN 'year' ELSE 'month' END AS period_type
  FROM (SELECT unnest([category, brand]) AS category, delegation, locality FROM sales)
  CROSS JOIN (SELECT CAST(NULL AS INTEGER) AS month UNION ALL SELECT 7)
)"""


PREDICTED = ["category", "delegation", "locality", "month", "period_type"]
TOTALLED = ["delegation", "locality", "month", "period_type"]


@register("predict_sales")
def q_predict_sales(spark, folder):
    return sales_model.predict_sales(sales_requests(spark, folder), fitted_sales_model(spark, folder)[1])


@register("predict_sales_residuals", f"WITH {SALES}, {ASKED_SALES} SELECT *, 0.0::DOUBLE AS distance FROM asked")
def q_predict_sales_residuals(spark, folder):
    """How far each prediction is from that of the node table, scored by joins."""
    model, asked = fitted_sales_model(spark, folder)[1], work_table(sales_requests(spark, folder))
    again = sales_model.predict_sales(asked, NodeModel(spark, model, "mean"))
    return distance(sales_model.predict_sales(asked, model), again, PREDICTED, "predicted_revenue")


@register("total_prediction")
def q_total_prediction(spark, folder):
    found = sales_model.predict_sales(sales_requests(spark, folder), fitted_sales_model(spark, folder)[1])
    return sales_model.total_prediction(found)


@register(
    "total_prediction_residuals",
    f"""WITH {SALES}, {ASKED_SALES} SELECT delegation, locality, month, period_type, count(*) AS category_count,
    0.0::DOUBLE AS distance FROM asked GROUP BY 1, 2, 3, 4""",
)
def q_total_prediction_residuals(spark, folder):
    """How far each total is from the sum over the node table's predictions."""
    model, asked = fitted_sales_model(spark, folder)[1], work_table(sales_requests(spark, folder))
    found = work_table(sales_model.total_prediction(sales_model.predict_sales(asked, model)))
    again = sales_model.total_prediction(sales_model.predict_sales(asked, NodeModel(spark, model, "mean")))
    counts = found.select(*[F.col(k).alias(f"_{k}") for k in TOTALLED], "category_count")
    apart = distance(found, again, TOTALLED, "total_revenue")
    return apart.join(counts, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in TOTALLED]).select(*apart.columns, "category_count")


@register(
    "save_and_load_model",
    f"WITH {SALES} SELECT count(*) AS predictions, CAST(0 AS BIGINT) AS differences FROM ({V2_ROWS})",
)
def q_save_and_load_model(spark, folder):
    """Predictions of a model that was saved and read back, and how many differ from its own."""
    rows, model, metrics = fitted_sales_model(spark, folder)
    path = scratch_path(spark)
    save_model(model, metrics, path)
    loaded = load_model(spark, path)[0]
    own = model.transform(rows).select(*sales_model.PLACE, "month", "prediction")
    again = loaded.transform(rows).select(*sales_model.PLACE, "month", F.col("prediction").alias("read_back"))
    differs = ~F.col("prediction").eqNullSafe(F.col("read_back"))
    return own.join(again, [*sales_model.PLACE, "month"]).agg(
        F.count("*").alias("predictions"), F.count_if(differs).alias("differences")
    )


def features(spark, folder):
    return kpi.customer_features(sales(spark, folder, "client_id", "total_price", "quantity"))


def fitted_classifier(spark, folder):
    rows = work_table(features(spark, folder))

    def train():
        made = customers.high_value_classifier(rows)
        return made.model, made.metrics

    return versioned_model(rows, "high-value", train)


@register("high_value_classifier")
def q_high_value_classifier(spark, folder):
    return fitted_classifier(spark, folder)[1]


def value_requests(spark, folder):
    """Requests made from every order: its price and, for some, no quantity."""
    quantity = F.when(F.col("o_custkey") % 9 == 0, 0).otherwise(F.col("o_custkey") % 9 * 10).cast("int")
    return table(spark, folder, "orders").select(F.col("o_totalprice").alias("total"), quantity.alias("qty"))


@register("predict_high_value")
def q_predict_high_value(spark, folder):
    return customers.predict_high_value(value_requests(spark, folder), fitted_classifier(spark, folder)[0])


@register(
    "predict_high_value_residuals",
    """SELECT DISTINCT o_totalprice AS total, CAST(o_custkey % 9 * 10 AS INTEGER) AS qty, 0.0::DOUBLE AS distance FROM orders""",
)
def q_predict_high_value_residuals(spark, folder):
    """How far each predicted class is from the vote of the node table's leaves."""
    model, asked = fitted_classifier(spark, folder)[0], work_table(value_requests(spark, folder).distinct())
    again = customers.predict_high_value(asked, NodeModel(spark, model, "vote"))
    return distance(customers.predict_high_value(asked, model), again, ["total", "qty"], "prediction")


@register("segment_customers")
def q_segment_customers(spark, folder):
    return customers.segment_customers(features(spark, folder))


@register(
    "segment_customers_residuals",
    f"WITH {SALES} SELECT DISTINCT client_id, 0.0::DOUBLE AS excess, 0.0::DOUBLE AS drift FROM sales",
)
def q_segment_customers_residuals(spark, folder):
    """Every client: how much nearer another centre is, and how far its own is off the mean of the cluster."""
    rows = work_table(customers.usable(features(spark, folder)).select("client_id", *customers.FEATURES))
    residuals = customers.segment_residuals(rows, work_table(customers.segment_customers(rows)))
    return residuals.withColumns({c: F.abs(F.round(c, 6)) for c in ("excess", "drift")})
