"""Revenue and activity indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emporia.functions import month_start, season
from emporia.functions.numbers import py_round
from emporia.schema import BASKET_KEYS
from emporia.sources.store import work_table


def total_sales(fact: DataFrame) -> DataFrame:
    """Σ of the monthly revenue series; filled-in months add nothing, so a plain sum."""
    return fact.agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_sales"))


def kpi_product(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue from the fact, distinct names and brands from the product dimension."""
    counts = products.agg(F.struct(F.countDistinct("product_name").alias("names"), F.countDistinct("brand").alias("brands")))
    found = counts.scalar()
    revenue = fact.agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"))
    return revenue.select(
        py_round(F.col("revenue"), 2).alias("revenue"),
        found["names"].alias("product_count"),
        found["brands"].alias("brand_count"),
    )


def kpi_time(fact: DataFrame) -> DataFrame:
    """`mean_revenue` is per purchase line, as is `row_count`; neither is per basket."""
    return fact.agg(
        py_round(F.coalesce(F.sum("revenue"), F.lit(0.0)), 2).alias("revenue"),
        F.count("*").alias("row_count"),
        py_round(F.avg("revenue"), 2).alias("mean_revenue"),
    )


def kpi_geo(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.countDistinct("client_id").alias("client_count"),
        F.countDistinct("locality").alias("locality_count"),
        F.countDistinct("delegation").alias("delegation_count"),
    )


def revenue_by(fact: DataFrame, key: str | Column, name: str | None = None) -> DataFrame:
    """Σ revenue per key; rows without a key are left out."""
    column = F.col(key) if isinstance(key, str) else key
    label = name or key
    return (
        fact.select(column.alias(label), "revenue")
        .where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.sum("revenue").alias("revenue"))
    )


def revenue_by_category(fact: DataFrame) -> DataFrame:
    return revenue_by(fact, "category")


def mean_revenue_by_category(fact: DataFrame) -> DataFrame:
    return (
        fact.where("category IS NOT NULL").groupBy("category").agg(F.avg("revenue").alias("mean_revenue"))
    )


def revenue_by_brand(fact: DataFrame, n: int | None = None) -> DataFrame:
    """In label order; `n` keeps the first labels, as the chart does with 15."""
    ordered = revenue_by(fact, "brand").orderBy("brand")
    return ordered.limit(n) if n else ordered


def revenue_by_quarter(fact: DataFrame) -> DataFrame:
    return revenue_by(fact, F.quarter("purchase_date"), "quarter")


def revenue_by_month(fact: DataFrame) -> DataFrame:
    return revenue_by(fact, F.date_format("purchase_date", "yyyy-MM"), "month")


def revenue_by_season(fact: DataFrame) -> DataFrame:
    return revenue_by(fact.where("purchase_date IS NOT NULL"), season(F.col("purchase_date")), "season")


def clients_by_delegation(fact: DataFrame) -> DataFrame:
    return (
        fact.where("delegation IS NOT NULL")
        .groupBy("delegation")
        .agg(F.countDistinct("client_id").alias("client_count"))
    )


def monthly_series(fact: DataFrame, key: str | None = None, value: str = "revenue") -> DataFrame:
    """Dense (series_key, ds, y): Σ value per month, 0 in months without purchases.

    A month's row is repeated up to the month before the next one, which fills the gaps without
    joining a calendar. Without `key` there is one series called "all".
    """
    series = F.col(key) if key else F.lit("all")
    monthly = (
        fact.select(series.alias("series_key"), month_start(F.col("purchase_date")).alias("ds"), value)
        .where("series_key IS NOT NULL AND ds IS NOT NULL")
        .groupBy("series_key", "ds")
        .agg(F.sum(value).alias("y"))
    )
    following = F.lead("ds").over(W.partitionBy("series_key").orderBy("ds"))
    last = F.coalesce(F.add_months(following, -1), F.col("ds"))
    return monthly.withColumn("_last", last).select(
        "series_key", F.col("ds").alias("_from"), "y",
        F.explode(F.sequence("ds", "_last", F.expr("INTERVAL 1 MONTH"))).alias("ds"),
    ).select(
        "series_key", "ds",
        F.when(F.col("ds") == F.col("_from"), F.coalesce("y", F.lit(0.0))).otherwise(0.0).alias("y"),
    )


def daily_quantity_series(fact: DataFrame, product: str | None = None) -> DataFrame:
    """Σ quantity per date of one product, or of each product."""
    rows = fact.where(F.col("product_name") == product) if product else fact
    return (
        rows.where("product_name IS NOT NULL AND purchase_date IS NOT NULL")
        .groupBy("product_name", F.col("purchase_date").alias("ds"))
        .agg(F.sum("quantity").alias("y"))
    )


def exact_median(df: DataFrame, value: str, cells: int = 4096, few: int = 4096) -> DataFrame:
    """One row with the exact median of a column, without gathering the column in one task.

    The two middle values are selected by refining a histogram: rows are counted in `cells` equal cells of
    the range in which they must lie, and the cells that hold them are the next range. Cells are counts that
    combine before the shuffle. A range ends with at most `few` distinct values (a value repeated any
    number of times is one), which are ranked. The input is read once a round, so pass a stored table.
    """
    values = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    first, last, below = (n + 1) // 2, n // 2 + 1, 0  # places of the middle values; rows below the range
    while n:
        inside = values.where(F.col("v").between(low, high))
        width = (high - low) / cells
        distinct = inside.agg(F.approx_count_distinct("v")).first()[0]
        if distinct <= few // 2 or width == 0 or low + width == low:
            break
        cell = F.least(F.floor((F.col("v") - low) / width), F.lit(cells - 1))
        counts = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto, found = below, []
        for r in sorted(counts.collect(), key=lambda r: r.cell):  # at most `cells` rows
            if upto < last and upto + r.c >= first:
                found.append((upto, r.low, r.high))
            upto += r.c
        if len(found) == 2:  # one middle value ends a cell, the other begins the next
            return df.sparkSession.createDataFrame([((found[0][2] + found[1][1]) / 2,)], "median double")
        below, low, high = found[0]
    ranked = values.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("c"))
    ranked = ranked.withColumn("upto", F.sum("c").over(W.orderBy("v")) + below)
    lower = F.min(F.when(F.col("upto") >= first, F.col("v")))
    upper = F.min(F.when(F.col("upto") >= last, F.col("v")))
    return ranked.agg(((lower + upper) / 2).alias("median"))


def customer_features(fact: DataFrame) -> DataFrame:
    """Totals per client, spend per unit (null at zero quantity), and whether spend exceeds the median."""
    totals = work_table(
        fact.where("client_id IS NOT NULL")
        .groupBy("client_id")
        .agg(
            F.round(F.sum("total_price"), 4).alias("total_price"),
            F.sum("quantity").alias("quantity"),
        )
    )
    median = exact_median(totals, "total_price").scalar()
    return totals.select(
        "client_id",
        "total_price",
        "quantity",
        F.try_divide("total_price", "quantity").alias("mean_spend"),
        (F.col("total_price") > median).cast("int").alias("high_value"),
    )


def avg_price(fact: DataFrame) -> DataFrame:
    return fact.agg(F.avg("total_price").alias("average_price"))


def basket_diagnostics(fact: DataFrame) -> DataFrame:
    """Basket sizes in rows; `too_granular` warns that most baskets hold one row."""
    sizes = (
        fact.where("trim(product_name) <> ''")
        .dropna(subset=BASKET_KEYS)
        .groupBy(*BASKET_KEYS)
        .agg(F.count("*").alias("size"))
    )
    single = F.count_if(F.col("size") == 1)
    several = F.count_if(F.col("size") >= 2)
    return sizes.agg(
        F.count("*").alias("basket_count"),
        F.avg("size").alias("mean_size"),
        F.max("size").alias("max_size"),
        single.alias("single_count"),
        F.try_divide(single, F.count("*")).alias("single_share"),
        several.alias("several_count"),
        F.try_divide(several, F.count("*")).alias("several_share"),
        (F.avg("size") < 1.5).alias("too_granular"),
    )


def account_stats(accounts: DataFrame) -> DataFrame:
    return accounts.agg(
        F.count("*").alias("account_count"), F.count("last_login").alias("logged_in_count")
    )


def signups_by_month(accounts: DataFrame) -> DataFrame:
    return (
        accounts.groupBy(F.date_format("created_at", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("account_count"))
        .orderBy("month")
    )
