from __future__ import annotations

from pyspark.sql import functions as F

from emporia.operators import forecast
from emporia.operators.kpi import monthly_series
from emporia.operators.trees import NodeModel, distance
from emporia.plans.registry import r, register, tidy
from emporia.plans.views import MONTHLY, SALES
from emporia.sources.star import sales
from emporia.sources.store import versioned_model, work_table


def product_series(spark, folder, value="revenue"):
    return monthly_series(sales(spark, folder, "product_name", "purchase_date", value), "product_name", value)


@register(
    "calendar_lag_features",
    f"""WITH {SALES}, {MONTHLY}, lagged AS (
      SELECT series_key, ds, y, month(ds) AS month, year(ds) AS year, quarter(ds) AS quarter,
        lag(y, 1) OVER w AS lag1, lag(y, 2) OVER w AS lag2, lag(y, 3) OVER w AS lag3
      FROM series WINDOW w AS (PARTITION BY series_key ORDER BY ds))
    SELECT series_key, ds, {r('y', 2)} AS y, CAST(month AS INTEGER) AS month, CAST(year AS INTEGER) AS year,
      CAST(quarter AS INTEGER) AS quarter, {r('lag1', 2)} AS lag1, {r('lag2', 2)} AS lag2, {r('lag3', 2)} AS lag3
    FROM lagged WHERE lag3 IS NOT NULL""",
)
def q_calendar_lag_features(spark, folder):
    return tidy(forecast.calendar_lag_features(product_series(spark, folder)), 2)


@register(
    "chrono_split",
    f"""WITH {SALES}, {MONTHLY} SELECT series_key, ds, {r('y', 2)} AS y,
      row_number() OVER (PARTITION BY series_key ORDER BY ds)
        <= floor(count(*) OVER (PARTITION BY series_key) * CAST(0.8 AS DOUBLE)) AS is_train FROM series""",
)
def q_chrono_split(spark, folder):
    return tidy(forecast.chrono_split(product_series(spark, folder)), 2)


SMOOTH = """smooth AS (
  SELECT series_key, ds, avg(y) OVER (PARTITION BY series_key ORDER BY ds ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS y
  FROM series
)"""


@register("smooth3", f"WITH {SALES}, {MONTHLY}, {SMOOTH} SELECT series_key, ds, {r('y')} AS y FROM smooth")
def q_smooth3(spark, folder):
    return tidy(forecast.smooth3(product_series(spark, folder)))


def fit_sql(rows: str) -> str:
    """Trend and month factors of the series in `rows`."""
    return f"""timed AS (
      SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS t,
        count(*) OVER (PARTITION BY series_key) AS n, max(ds) OVER (PARTITION BY series_key) AS last_ds FROM {rows}
    ), line AS (
      SELECT series_key, n, last_ds, (n - 1) / 2 AS middle, avg(y) AS level,
        coalesce(sum((t - (n - 1) / 2) * y) / nullif(sum((t - (n - 1) / 2) * (t - (n - 1) / 2)), 0), 0) AS slope
      FROM timed GROUP BY 1, 2, 3
    ), ratios AS (
      SELECT t.series_key, month(t.ds) AS m, t.y / nullif(greatest(level + slope * (t.t - middle), 0), 0) AS ratio
      FROM timed t JOIN line USING (series_key)
    ), factors AS (
      SELECT series_key, m, avg(ratio) AS factor FROM ratios GROUP BY 1, 2
    )"""


def seasonal_sql(periods: int, rows: str = "smooth") -> str:
    return f"""{fit_sql(rows)}, future AS (
      SELECT line.*, unnest(range(1, {periods} + 1)) AS step FROM line
    ), dated AS (
      SELECT *, CAST(last_ds + to_months(CAST(step AS INTEGER)) AS DATE) AS ds FROM future
    ), predicted AS (
      SELECT d.series_key, d.ds,
        greatest((level + slope * (n - 1 + step - middle)) * coalesce(factor, 1), 0) AS yhat
      FROM dated d LEFT JOIN factors f ON f.series_key = d.series_key AND f.m = month(d.ds)
    )"""


@register(
    "forecast_seasonal",
    f"""WITH {SALES}, {MONTHLY}, {SMOOTH}, {seasonal_sql(3)}
    SELECT series_key, ds, {r('yhat', 2)} AS yhat FROM predicted""",
)
def q_forecast_seasonal(spark, folder):
    return tidy(forecast.forecast_seasonal(product_series(spark, folder)), 2)


@register(
    "forecast_metrics",
    f"""WITH {SALES}, {MONTHLY}, {SMOOTH}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS place,
        floor(count(*) OVER (PARTITION BY series_key) * CAST(0.8 AS DOUBLE)) AS cut FROM smooth
    ), train AS (SELECT series_key, ds, y FROM placed WHERE place < cut), {fit_sql('train')}, scored AS (
      SELECT p.series_key, p.y, greatest((level + slope * (place - middle)) * coalesce(factor, 1), 0) AS yhat
      FROM placed p JOIN line USING (series_key)
      LEFT JOIN factors f ON f.series_key = p.series_key AND f.m = month(p.ds) WHERE place >= cut
    )
    SELECT series_key, count(*) AS row_count, {r('avg(abs(y - yhat))', 2)} AS mae,
      {r('sqrt(avg((y - yhat) * (y - yhat)))', 2)} AS rmse,
      {r('CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - avg((y - yhat) * (y - yhat)) / var_pop(y) END', 2)} AS r2
    FROM scored GROUP BY 1""",
)
def q_forecast_metrics(spark, folder):
    return tidy(forecast.forecast_metrics(forecast.seasonal_holdout(product_series(spark, folder))), 2)


@register(
    "demand_level",
    f"""WITH {SALES}, {MONTHLY}, {SMOOTH}, {seasonal_sql(6)}, shares AS (
      SELECT *, 100 * yhat / greatest(max(yhat) OVER (PARTITION BY series_key), 1) AS percent FROM predicted)
    SELECT series_key, ds, {r('yhat', 2)} AS yhat, {r('percent', 2)} AS percent,
      CASE WHEN percent > 70 THEN 'Forte demande' WHEN percent > 40 THEN 'Demande modérée' ELSE 'Faible demande' END AS level
    FROM shares""",
)
def q_demand_level(spark, folder):
    return tidy(forecast.demand_level(forecast.forecast_seasonal(product_series(spark, folder), 6)), 2)


@register(
    "stock_advice",
    f"""WITH {SALES}, {MONTHLY}, {SMOOTH.replace('avg(y)', 'avg(q)')}, {seasonal_sql(3)}, last AS (
      SELECT series_key, arg_max(yhat, ds) AS demand FROM predicted GROUP BY 1
    ), stock AS (SELECT product_name, avg(quantity) AS stock FROM sales GROUP BY 1)
    SELECT product_name, {r('demand', 2)} AS predicted_demand, {r('stock', 2)} AS current_stock, 'BUY MORE' AS action
    FROM last JOIN stock ON product_name = series_key WHERE demand > stock""",
)
def q_stock_advice(spark, folder):
    return tidy(forecast.stock_advice(sales(spark, folder, "product_name", "purchase_date", "quantity")), 2)


def boosted_products(spark, folder):
    """The stored series, and their model and its metrics from the model store."""
    series = work_table(product_series(spark, folder))
    return series, *versioned_model(series, "boosted", lambda: tuple(forecast.train_boosted(series)), forecast.ROUNDS)


def months_after(last: str, periods: int, key: str = "") -> str:
    return f"""SELECT {key}CAST(last_ds + to_months(CAST(step AS INTEGER)) AS DATE) AS ds, 0.0::DOUBLE AS distance
    FROM (SELECT {key}last_ds, unnest(range(1, {periods} + 1)) AS step FROM ({last}))"""


@register("forecast_boosted")
def q_forecast_boosted(spark, folder):
    """Hold-out metrics of the boosted trees for every product."""
    return boosted_products(spark, folder)[2]


@register(
    "forecast_boosted_residuals",
    f"""WITH {SALES}, {MONTHLY}, lagged AS (SELECT series_key, count(*) - 3 AS n FROM series GROUP BY 1)
    SELECT series_key, n - CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS row_count, 0.0::DOUBLE AS mae_distance,
      0.0::DOUBLE AS rmse_distance FROM lagged WHERE n >= 10""",
)
def q_forecast_boosted_residuals(spark, folder):
    """How far the hold-out errors are from those of the node table's predictions."""
    series, model, metrics = boosted_products(spark, folder)
    again = work_table(forecast.holdout_metrics(forecast.training_rows(series), NodeModel(spark, model, "sum")))
    off = {c: distance(metrics, again, ["series_key"], c).withColumnRenamed("distance", f"{c}_distance") for c in ("mae", "rmse")}
    return again.select("series_key", "row_count").join(off["mae"], "series_key").join(off["rmse"], "series_key")


@register("forecast_recursive")
def q_forecast_recursive(spark, folder):
    series, model, _ = boosted_products(spark, folder)
    return forecast.forecast_recursive(series, model, 3)


@register(
    "forecast_recursive_residuals",
    f"WITH {SALES}, {MONTHLY} {months_after('SELECT series_key, max(ds) AS last_ds FROM series GROUP BY 1', 3, 'series_key, ')}",
)
def q_forecast_recursive_residuals(spark, folder):
    """How far each forecast is from one whose steps are scored by the node table."""
    series, model, _ = boosted_products(spark, folder)
    again = forecast.forecast_recursive(series, NodeModel(spark, model, "sum"), 3)
    return distance(forecast.forecast_recursive(series, model, 3), again, ["series_key", "ds"], "yhat")


@register("forecast_total")
def q_forecast_total(spark, folder):
    return forecast.forecast_total(sales(spark, folder, "purchase_date", "revenue"))


@register("forecast_product")
def q_forecast_product(spark, folder):
    return forecast.forecast_product(sales(spark, folder, "product_name", "purchase_date", "revenue"), "gizmo")
