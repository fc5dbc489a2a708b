from __future__ import annotations

from emporia.operators import clean, kpi, topk
from emporia.plans.cleaning import fact as cleaned
from emporia.plans.registry import r, register, texts, tidy
from emporia.plans.views import FACT, MONTHLY, SALES
from emporia.sources.star import accounts, sales


@register("total_sales", f"WITH {SALES} SELECT {r('sum(revenue)', 2)} AS total_sales FROM sales")
def q_total_sales(spark, folder):
    return tidy(kpi.total_sales(sales(spark, folder, "revenue")), 2)


@register(
    "kpi_product",
    f"""WITH {SALES} SELECT {r('sum(revenue)', 2)} AS revenue, count(DISTINCT product_name) AS product_count,
    count(DISTINCT brand) AS brand_count FROM sales""",
)
def q_kpi_product(spark, folder):
    fact = sales(spark, folder, "product_id", "product_name", "brand", "category", "revenue")
    return kpi.kpi_product(fact, clean.dim_product(fact))


@register(
    "kpi_time",
    f"""WITH {SALES} SELECT {r('sum(revenue)', 2)} AS revenue, count(*) AS row_count,
    {r('avg(revenue)', 2)} AS mean_revenue FROM sales""",
)
def q_kpi_time(spark, folder):
    return kpi.kpi_time(sales(spark, folder, "revenue"))


GEO_SQL = """SELECT count(DISTINCT client_id) AS client_count, count(DISTINCT locality) AS locality_count,
    count(DISTINCT delegation) AS delegation_count FROM """


@register("kpi_geo", f"WITH {SALES} {GEO_SQL} sales")
def q_kpi_geo(spark, folder):
    return kpi.kpi_geo(sales(spark, folder, "client_id", "locality", "delegation"))


@register("kpi_geo_cleaned", f"WITH {FACT} {GEO_SQL} fact")
def q_kpi_geo_cleaned(spark, folder):
    return kpi.kpi_geo(cleaned(spark, folder))


def revenue_sql(key: str, name: str, start: str = SALES, rows: str = "sales") -> str:
    return (
        f"WITH {start} SELECT {key} AS {name}, {r('sum(revenue)', 2)} AS revenue FROM {rows} "
        f"WHERE {key} IS NOT NULL GROUP BY 1"
    )


@register("revenue_by_category", revenue_sql("category", "category"))
def q_revenue_by_category(spark, folder):
    return tidy(kpi.revenue_by_category(sales(spark, folder, "category", "revenue")), 2)


@register(
    "mean_revenue_by_category",
    f"WITH {SALES} SELECT category, {r('avg(revenue)')} AS mean_revenue FROM sales WHERE category IS NOT NULL GROUP BY 1",
)
def q_mean_revenue_by_category(spark, folder):
    return tidy(kpi.mean_revenue_by_category(sales(spark, folder, "category", "revenue")))


@register("revenue_by_brand", revenue_sql("brand", "brand"))
def q_revenue_by_brand(spark, folder):
    return tidy(kpi.revenue_by_brand(sales(spark, folder, "brand", "revenue")), 2)


@register("revenue_by_brand_chart", revenue_sql("brand", "brand") + " ORDER BY 1 LIMIT 15")
def q_revenue_by_brand_chart(spark, folder):
    return tidy(kpi.revenue_by_brand(sales(spark, folder, "brand", "revenue"), 15), 2)


@register("revenue_by_quarter", revenue_sql("CAST(quarter(purchase_date) AS INTEGER)", "quarter"))
def q_revenue_by_quarter(spark, folder):
    return tidy(kpi.revenue_by_quarter(sales(spark, folder, "purchase_date", "revenue")), 2)


@register("revenue_by_month", revenue_sql("strftime(purchase_date, '%Y-%m')", "month"))
def q_revenue_by_month(spark, folder):
    return tidy(kpi.revenue_by_month(sales(spark, folder, "purchase_date", "revenue")), 2)


SEASON_SQL = """CASE WHEN month(purchase_date) IN (12, 1, 2) THEN 'Hiver'
  WHEN month(purchase_date) BETWEEN 3 AND 5 THEN 'Printemps'
  WHEN month(purchase_date) BETWEEN 6 AND 8 THEN 'Été' ELSE 'Automne' END"""


@register("revenue_by_season", revenue_sql(SEASON_SQL, "season"))
def q_revenue_by_season(spark, folder):
    return tidy(kpi.revenue_by_season(sales(spark, folder, "purchase_date", "revenue")), 2)


CLIENTS_SQL = "SELECT delegation, count(DISTINCT client_id) AS client_count FROM {} WHERE delegation IS NOT NULL GROUP BY 1"


@register("clients_by_delegation", f"WITH {SALES} {CLIENTS_SQL.format('sales')}")
def q_clients_by_delegation(spark, folder):
    return kpi.clients_by_delegation(sales(spark, folder, "delegation", "client_id"))


@register("clients_by_delegation_cleaned", f"WITH {FACT} {CLIENTS_SQL.format('fact')}")
def q_clients_by_delegation_cleaned(spark, folder):
    """On the cleaned rows, some of which have no delegation."""
    return kpi.clients_by_delegation(cleaned(spark, folder))


@register(
    "monthly_series",
    f"WITH {SALES}, {MONTHLY} SELECT series_key, ds, {r('y', 2)} AS y FROM series",
)
def q_monthly_series(spark, folder):
    fact = sales(spark, folder, "product_name", "purchase_date", "revenue")
    return tidy(kpi.monthly_series(fact, "product_name"), 2)


@register(
    "monthly_series_total",
    f"""WITH {SALES}, sums AS (
      SELECT date_trunc('month', purchase_date) AS ds, sum(revenue) AS y FROM sales GROUP BY 1
    ), months AS (
      SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds FROM sums
    )
    SELECT 'all' AS series_key, CAST(m.ds AS DATE) AS ds, {r('coalesce(y, 0)', 2)} AS y
    FROM months m LEFT JOIN sums s ON s.ds = m.ds""",
)
def q_monthly_series_total(spark, folder):
    return tidy(kpi.monthly_series(sales(spark, folder, "purchase_date", "revenue")), 2)


@register(
    "daily_quantity_series",
    f"""WITH {SALES} SELECT product_name, purchase_date AS ds, {r('sum(quantity)', 2)} AS y FROM sales
    WHERE product_name IS NOT NULL AND purchase_date IS NOT NULL GROUP BY 1, 2""",
)
def q_daily_quantity_series(spark, folder):
    return tidy(kpi.daily_quantity_series(sales(spark, folder, "product_name", "purchase_date", "quantity")), 2)


CUSTOMERS_SQL = f"""totals AS (
      SELECT client_id, round(sum(total_price), 4) AS total_price, sum(quantity) AS quantity
      FROM sales WHERE client_id IS NOT NULL GROUP BY 1
    ), customers AS (
      SELECT client_id, total_price, quantity, total_price / nullif(quantity, 0) AS mean_spend,
             CAST(total_price > (SELECT median(total_price) FROM totals) AS INTEGER) AS high_value
      FROM totals
    )"""


@register(
    "customer_features",
    f"""WITH {SALES}, {CUSTOMERS_SQL} SELECT client_id, {r('total_price')} AS total_price,
    {r('quantity')} AS quantity, {r('mean_spend')} AS mean_spend, high_value FROM customers""",
)
def q_customer_features(spark, folder):
    return tidy(kpi.customer_features(sales(spark, folder, "client_id", "total_price", "quantity")))


@register("avg_price", f"WITH {SALES} SELECT {r('avg(total_price)')} AS average_price FROM sales")
def q_avg_price(spark, folder):
    return tidy(kpi.avg_price(sales(spark, folder, "total_price")))


@register(
    "basket_diagnostics",
    f"""WITH {SALES}, sizes AS (
      SELECT client_id, purchase_date, count(*) AS size FROM sales WHERE trim(product_name) <> '' GROUP BY 1, 2)
    SELECT count(*) AS basket_count, {r('avg(size)')} AS mean_size, max(size) AS max_size,
      count(*) FILTER (size = 1) AS single_count, {r('count(*) FILTER (size = 1) / count(*)')} AS single_share,
      count(*) FILTER (size >= 2) AS several_count, {r('count(*) FILTER (size >= 2) / count(*)')} AS several_share,
      avg(size) < 1.5 AS too_granular FROM sizes""",
)
def q_basket_diagnostics(spark, folder):
    return tidy(kpi.basket_diagnostics(sales(spark, folder, "client_id", "purchase_date", "product_name")))


ACCOUNTS_SQL = """accounts AS (
  SELECT user_id AS id, min(ts) FILTER (event_type = 'signup') AS created_at,
         max(ts) FILTER (event_type = 'click') AS last_login
  FROM events GROUP BY 1
)"""


@register(
    "account_stats",
    f"WITH {ACCOUNTS_SQL} SELECT count(*) AS account_count, count(last_login) AS logged_in_count FROM accounts",
)
def q_account_stats(spark, folder):
    return kpi.account_stats(accounts(spark, folder))


@register(
    "signups_by_month",
    f"WITH {ACCOUNTS_SQL} SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS account_count FROM accounts GROUP BY 1",
)
def q_signups_by_month(spark, folder):
    return kpi.signups_by_month(accounts(spark, folder))


def top_sql(key: str, measure: str, into: str, n: int, where: str = "true") -> str:
    value = r(measure, 2) if into != "row_count" else measure
    return (
        f"WITH {SALES} SELECT {key}, {value} AS {into} FROM sales WHERE {key} IS NOT NULL AND {where} "
        f"GROUP BY 1 ORDER BY {measure} DESC, 1 LIMIT {n}"
    )


@register("top_products_by_rows", top_sql("product_name", "count(*)", "row_count", 5))
def q_top_products_by_rows(spark, folder):
    return topk.top_products_by_rows(sales(spark, folder, "product_name"))


@register(
    "top_products_by_rows_in_slice",
    top_sql("product_name", "count(*)", "row_count", 8, "category = 'PROMO' AND delegation = 'ASIA'"),
)
def q_top_products_in_slice(spark, folder):
    fact = sales(spark, folder, "product_name", "category", "delegation")
    return topk.top_products_by_rows(fact, 8, "PROMO", "ASIA")


@register("top_products_by_quantity", top_sql("product_name", "sum(quantity)", "quantity", 10))
def q_top_products_by_quantity(spark, folder):
    return tidy(topk.top_products_by_quantity(sales(spark, folder, "product_name", "quantity")), 2)


@register("top_products_by_revenue", top_sql("product_name", "sum(revenue)", "revenue", 10))
def q_top_products_by_revenue(spark, folder):
    return tidy(topk.top_products_by_revenue(sales(spark, folder, "product_name", "revenue")), 2)


@register("top_delegations", top_sql("delegation", "sum(revenue)", "revenue", 10))
def q_top_delegations(spark, folder):
    return tidy(topk.top_delegations(sales(spark, folder, "delegation", "revenue")), 2)


@register("top_localities", top_sql("locality", "sum(revenue)", "revenue", 10))
def q_top_localities(spark, folder):
    return tidy(topk.top_localities(sales(spark, folder, "locality", "revenue")), 2)


@register(
    "top_delegations_cleaned",
    revenue_sql("delegation", "delegation", FACT, "fact") + " ORDER BY sum(revenue) DESC LIMIT 10",
)
def q_top_delegations_cleaned(spark, folder):
    return tidy(topk.top_delegations(cleaned(spark, folder)), 2)


@register("top_categories", top_sql("category", "count(*)", "row_count", 5))
def q_top_categories(spark, folder):
    return topk.top_categories(sales(spark, folder, "category"))


@register("customer_products", top_sql("product_name", "sum(quantity)", "quantity", 1000000000, "client_id = '7'"))
def q_customer_products(spark, folder):
    return tidy(topk.customer_products(sales(spark, folder, "client_id", "product_name", "quantity"), "7"), 2)


@register(
    "top_products_per_delegation",
    f"""WITH {SALES}, totals AS (
      SELECT delegation, product_name, sum(quantity) AS quantity FROM sales
      WHERE delegation IS NOT NULL AND product_name IS NOT NULL GROUP BY 1, 2)
    SELECT delegation, product_name, {r('quantity', 2)} AS quantity, CAST(row_number() OVER (
      PARTITION BY delegation ORDER BY quantity DESC, product_name) AS INTEGER) AS rank
    FROM totals QUALIFY rank <= 5""",
)
def q_top_products_per_delegation(spark, folder):
    fact = sales(spark, folder, "delegation", "product_name", "quantity")
    return tidy(topk.top_products_per_delegation(fact), 2)


@register(
    "product_score",
    f"""WITH {SALES}, totals AS (
      SELECT product_name, sum(quantity) AS volume, sum(total_price) AS revenue, count(purchase_date) AS frequency
      FROM sales WHERE product_name IS NOT NULL GROUP BY 1)
    SELECT product_name, {r('volume', 2)} AS volume, {r('revenue', 2)} AS revenue, frequency,
      {r('volume * 0.5 + revenue * 0.3 + frequency * 0.2', 2)} AS score
    FROM totals ORDER BY volume * 0.5 + revenue * 0.3 + frequency * 0.2 DESC, product_name LIMIT 10""",
)
def q_product_score(spark, folder):
    fact = sales(spark, folder, "product_name", "quantity", "total_price", "purchase_date")
    return tidy(topk.product_score(fact), 2)


@register(
    "compare_regions",
    f"""WITH {SALES}, counts AS (
      SELECT delegation, product_name, count(*) AS row_count FROM sales
      WHERE delegation IN ('ASIA', 'EUROPE') GROUP BY 1, 2
    ), top AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY delegation ORDER BY row_count DESC, product_name) AS INTEGER) AS rank
      FROM counts QUALIFY rank <= 5)
    SELECT *, count(*) OVER (PARTITION BY product_name) = 2 AS common FROM top""",
)
def q_compare_regions(spark, folder):
    return topk.compare_regions(sales(spark, folder, "delegation", "product_name"), "ASIA", "EUROPE")


def mode_sql(key: str) -> str:
    return f"(SELECT {key} FROM sales WHERE {key} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@register(
    "auto_insights",
    f"""WITH {SALES} SELECT {mode_sql('product_name')} AS top_product_name, {mode_sql('category')} AS top_category,
    {mode_sql('delegation')} AS top_delegation, (SELECT count(*) FROM sales) AS row_count""",
)
def q_auto_insights(spark, folder):
    return topk.auto_insights(sales(spark, folder, "product_name", "category", "delegation"))


@register(
    "store_starter_summary",
    f"""WITH {SALES} SELECT
      (SELECT string_agg(product_name, '|' ORDER BY q DESC, product_name) FROM (
        SELECT product_name, sum(quantity) AS q FROM sales GROUP BY 1 ORDER BY q DESC, 1 LIMIT 10)) AS top_products,
      {r('(SELECT avg(total_price) FROM sales)')} AS average_price,
      (SELECT string_agg(category, '|' ORDER BY c DESC, category) FROM (
        SELECT category, count(*) AS c FROM sales GROUP BY 1 ORDER BY c DESC, 1 LIMIT 5)) AS top_categories""",
)
def q_store_starter_summary(spark, folder):
    fact = sales(spark, folder, "product_name", "quantity", "total_price", "category")
    return texts(tidy(topk.store_starter_summary(fact)), "top_products", "top_categories")
