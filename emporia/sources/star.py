"""The star-schema tables as the purchase schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Declared so that opening a table needs no footer read.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

PART_COLUMNS = {"product_name", "brand", "category", "unit_price", "revenue"}
PLACE_COLUMNS = {"delegation", "locality"}
ORDER_COLUMNS = {"client_id", "purchase_date"} | PLACE_COLUMNS

EXPRESSIONS = {
    "client_id": "CAST(o_custkey AS STRING)",
    "purchase_date": "CAST(o_orderdate AS DATE)",
    "product_id": "CAST(l_partkey AS STRING)",
    "product_name": "p_name",
    "brand": "p_brand",
    "category": "p_type",
    "delegation": "r_name",
    "locality": "n_name",
    "quantity": "l_quantity",
    "unit_price": "p_retailprice",
    "total_price": "l_extendedprice",
    "revenue": "l_quantity * p_retailprice",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Purchases with the asked columns (default: all).

    Every line item has exactly one part, order, customer, nation and region, so a table none of
    whose columns is asked for is left out of the join.
    """
    wanted = list(columns) or list(EXPRESSIONS)
    asked = set(wanted)
    rows = table(spark, folder, "lineitem")
    if asked & PART_COLUMNS:
        rows = rows.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if asked & ORDER_COLUMNS:
        orders = table(spark, folder, "orders")
        if asked & PLACE_COLUMNS:
            places = table(spark, folder, "nation").join(
                table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
            )
            customers = table(spark, folder, "customer").join(
                places, F.col("c_nationkey") == F.col("n_nationkey")
            )
            orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(*[F.expr(EXPRESSIONS[c]).alias(c) for c in wanted])


def dirty_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as raw text with a deterministic set of faults; every cleaning rule bites."""
    rows = (
        sales(spark, folder)
        .withColumn("ck", F.col("client_id").cast("bigint"))
        .withColumn("pk", F.col("product_id").cast("bigint"))
        .withColumn("copies", F.when(F.col("ck") % 10 == 0, 2).otherwise(1))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    )
    return rows.select(
        F.when(F.col("ck") % 83 != 0, F.concat(F.lit(" "), "client_id", F.lit(" "))).alias("client_id"),
        F.when(F.col("ck") % 71 == 0, "n/d")
        .otherwise(F.date_format("purchase_date", "dd/MM/yyyy"))
        .alias("purchase_date"),
        "product_id",
        F.concat(F.lit("  "), F.upper("product_name"), F.lit(" ")).alias("product_name"),
        F.when(F.col("pk") % 40 == 0, " N/A ").otherwise(F.col("brand")).alias("brand"),
        "category",
        F.when(F.col("ck") % 50 != 0, F.col("delegation")).alias("delegation"),
        "locality",
        F.col("quantity").cast("string").alias("quantity"),
        F.when(F.col("pk") % 67 == 0, "0").otherwise(F.col("unit_price").cast("string")).alias("unit_price"),
        F.when(F.col("ck") % 61 == 0, "abc")
        .when(F.col("ck") % 59 == 0, "-1")
        .otherwise(F.col("total_price").cast("string"))
        .alias("total_price"),
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts seen in the event log: created at the first signup, last login at the last click."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("id"))
        .agg(
            F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("created_at"),
            F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("last_login"),
        )
    )
