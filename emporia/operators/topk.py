"""Rankings. Ties go to the first name by code point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emporia.operators.lookup import filter_slice

# Weights of the product score.
VOLUME_WEIGHT, REVENUE_WEIGHT, FREQUENCY_WEIGHT = 0.5, 0.3, 0.2

# Spark's own bound for trimming ranked groups before a shuffle, and our parts beyond it.
SPARK_TRIMS_UP_TO, PARTS = 1000, 64


def top_by(fact: DataFrame, key: str, measure: Column, into: str, n: int | None) -> DataFrame:
    totals = fact.where(F.col(key).isNotNull()).groupBy(key).agg(measure.alias(into))
    ordered = totals.orderBy(F.desc(into), key)
    return ordered.limit(n) if n else ordered


def ranked_within(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows per group with their `rank`.

    For usual n Spark trims each task's rows to n per group before the shuffle. It does not for
    large n, so then groups are first cut into parts and each part is trimmed on its own.
    """
    if n > SPARK_TRIMS_UP_TO:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        within = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order))
        df = df.withColumn("_part", part).withColumn("_place", within).where(F.col("_place") <= n)
        df = df.drop("_part", "_place")
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def top_products_by_rows(
    fact: DataFrame, n: int = 5, category: str | None = None, delegation: str | None = None
) -> DataFrame:
    return top_by(filter_slice(fact, category, delegation), "product_name", F.count("*"), "row_count", n)


def top_products_by_quantity(fact: DataFrame, n: int = 10) -> DataFrame:
    return top_by(fact, "product_name", F.sum("quantity"), "quantity", n)


def top_products_by_revenue(fact: DataFrame, n: int = 10) -> DataFrame:
    return top_by(fact, "product_name", F.sum("revenue"), "revenue", n)


def top_delegations(fact: DataFrame, n: int = 10) -> DataFrame:
    return top_by(fact, "delegation", F.sum("revenue"), "revenue", n)


def top_localities(fact: DataFrame, n: int = 10) -> DataFrame:
    return top_by(fact, "locality", F.sum("revenue"), "revenue", n)


def top_categories(fact: DataFrame, n: int = 5) -> DataFrame:
    return top_by(fact, "category", F.count("*"), "row_count", n)


def customer_products(fact: DataFrame, client_id: str) -> DataFrame:
    mine = fact.where(F.col("client_id") == client_id)
    return top_by(mine, "product_name", F.sum("quantity"), "quantity", None)


def top_products_per_delegation(fact: DataFrame, n: int = 5) -> DataFrame:
    totals = (
        fact.dropna(subset=["delegation", "product_name"])
        .groupBy("delegation", "product_name")
        .agg(F.sum("quantity").alias("quantity"))
    )
    return ranked_within(totals, ["delegation"], [F.desc("quantity"), F.col("product_name")], n)


def product_score(fact: DataFrame, n: int = 10) -> DataFrame:
    totals = (
        fact.where("product_name IS NOT NULL")
        .groupBy("product_name")
        .agg(
            F.sum("quantity").alias("volume"),
            F.sum("total_price").alias("revenue"),
            F.count("purchase_date").alias("frequency"),
        )
    )
    score = (
        F.col("volume") * VOLUME_WEIGHT
        + F.col("revenue") * REVENUE_WEIGHT
        + F.col("frequency") * FREQUENCY_WEIGHT
    )
    return totals.withColumn("score", score).orderBy(F.desc("score"), "product_name").limit(n)


def region_top_products(fact: DataFrame, n: int) -> DataFrame:
    """The n most frequent products of every delegation by row count."""
    counts = (
        fact.dropna(subset=["delegation", "product_name"])
        .groupBy("delegation", "product_name")
        .agg(F.count("*").alias("row_count"))
    )
    return ranked_within(counts, ["delegation"], [F.desc("row_count"), F.col("product_name")], n)


def compare_regions(fact: DataFrame, first: str, second: str, n: int = 5) -> DataFrame:
    """Top n of two regions; `common` marks products in both lists."""
    top = region_top_products(fact.where(F.col("delegation").isin(first, second)), n)
    both = F.count("*").over(W.partitionBy("product_name")) == 2
    return top.withColumn("common", both)


def auto_insights(fact: DataFrame) -> DataFrame:
    """Most frequent product, category and delegation and the row count, from one scan."""
    keys = ["product_name", "category", "delegation"]
    counts = (
        fact.groupingSets([[k] for k in keys] + [[]], *keys)
        .agg(F.count("*").alias("c"), F.grouping_id().alias("kind"))
    )
    # grouping_id sets the bit of every column left out: 3 product, 5 category, 6 delegation, 7 all.
    best = [
        F.min(
            F.when((F.col("kind") == kind) & F.col(k).isNotNull(), F.struct(-F.col("c"), F.col(k).alias("v")))
        ).getField("v").alias(f"top_{k}")
        for k, kind in zip(keys, (3, 5, 6))
    ]
    return counts.agg(*best, F.coalesce(F.max(F.when(F.col("kind") == 7, F.col("c"))), F.lit(0)).alias("row_count"))


def store_starter_summary(fact: DataFrame, products: int = 10, categories: int = 5) -> DataFrame:
    """Top products by quantity, mean price and top categories in one record."""

    def names(top: DataFrame, key: str, measure: str) -> Column:
        entry = F.struct((-F.col(measure)).alias("m"), F.col(key).alias("name"))
        listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["name"])
        return top.agg(listed).scalar()

    return fact.agg(F.avg("total_price").alias("average_price")).select(
        names(top_products_by_quantity(fact, products), "product_name", "quantity").alias("top_products"),
        "average_price",
        names(top_categories(fact, categories), "category", "row_count").alias("top_categories"),
    )
