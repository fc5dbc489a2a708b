"""From raw text rows to the cleaned purchase fact and the product dimension."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporia.schema import NUMBER_COLUMNS, TEXT_COLUMNS

# Texts that stand for "nothing" in a product's name, brand or category.
NULLISH = ["nan", "none", "", "unknown", "inconnu", "n/a", "na"]

# The columns that make two purchases the same.
DEDUP_KEYS = ["client_id", "purchase_date", "product_id", "total_price", "quantity"]


class CleanPurchases(NamedTuple):
    fact: DataFrame
    products: DataFrame


def number(column: str) -> Column:
    """Plain decimal or exponent notation, else null.

    A cast alone would also take `1d`, `NaN` or hexadecimal; plain text tests rule those out more
    cheaply than a pattern.
    """
    text = F.lower(F.trim(column))
    odd = text.contains("n") | text.contains("x") | F.right(text, F.lit(1)).isin("d", "f")
    return F.when(~odd, text.try_cast("double"))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Replace columns by expressions that later filters do not repeat.

    Spark pushes a filter on a computed column below the projection and computes the column again
    there; filters do not cross a generator of one row.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.inline(F.array(F.struct(*[value.alias(c) for c, value in columns.items()])))
    return df.select(*kept, made).select(*df.columns)


def coerce_types(raw: DataFrame, date_format: str = "d/M/yyyy") -> DataFrame:
    """Numbers and day-first dates from text; whatever does not parse becomes null."""
    numbers = {c: number(c) for c in NUMBER_COLUMNS}
    day = F.try_to_timestamp(F.col("purchase_date"), F.lit(date_format)).cast("date")
    return computed_once(raw, {**numbers, "purchase_date": day})


def filter_valid(df: DataFrame) -> DataFrame:
    """Keep rows with client, date and quantity, a positive total and a positive unit price."""
    return df.dropna(subset=["client_id", "purchase_date", "quantity"]).where(
        "total_price > 0 AND unit_price > 0"
    )


def normalize_text(df: DataFrame) -> DataFrame:
    folded = {c: F.lower(F.trim(c)) for c in TEXT_COLUMNS}
    return computed_once(df, {**folded, "client_id": F.trim("client_id")})


def drop_nullish(df: DataFrame) -> DataFrame:
    for c in TEXT_COLUMNS:
        df = df.where(~F.col(c).isin(NULLISH))  # a null is dropped as well
    return df


def dedup_purchases(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per client, date, product, total and quantity; null keys count as equal.

    The row with the smallest remaining values wins, or the first by `order_by`. It is picked by
    an aggregate, which combines copies before the shuffle, so one key with very many copies does
    not end up in one task.
    """
    rest = [c for c in df.columns if c not in DEDUP_KEYS]
    order = [c for c in (order_by or []) if c in rest]
    rest = order + [c for c in rest if c not in order]
    winner = df.groupBy(*DEDUP_KEYS).agg(F.min(F.struct(*rest)).alias("_row"))
    return winner.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


def add_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", F.col("quantity") * F.col("unit_price"))


def dim_product(fact: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per product id: the first by `order_by`, else by name, brand and category."""
    order = [c for c in (order_by or []) if c not in TEXT_COLUMNS]
    first = fact.groupBy("product_id").agg(F.min(F.struct(*order, *TEXT_COLUMNS)).alias("_row"))
    return first.select("product_id", *[F.col(f"_row.{c}").alias(c) for c in TEXT_COLUMNS])


def semi_valid_products(fact: DataFrame, products: DataFrame) -> DataFrame:
    """Purchases whose product is in the dimension; a null id matches a null id."""
    known = products.select(F.col("product_id").alias("_known_id"))
    return fact.join(known, F.col("product_id").eqNullSafe(F.col("_known_id")), "left_semi")


def clean_purchases(
    raw: DataFrame, date_format: str = "d/M/yyyy", order_by: list[str] | None = None
) -> CleanPurchases:
    """The whole chain. The dimension comes from the same rows, so every purchase is known and
    `semi_valid_products` would keep everything; it is left out to save a shuffle of the fact."""
    valid = filter_valid(coerce_types(raw, date_format))
    fact = add_revenue(dedup_purchases(drop_nullish(normalize_text(valid)), order_by))
    return CleanPurchases(fact, dim_product(fact, order_by))
