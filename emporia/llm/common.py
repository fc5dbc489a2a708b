"""Helpers shared by the corpus operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emporia.sources.store import work_table

# White space of the word rule: words are runs of anything else.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[ \t-\r]+"


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents", *(columns or ("doc_id", "text")))


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner != "", F.split(inner, SPACE_CLASS)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Without columns of these names: what an operator adds replaces what had its name."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def unused(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keeps_own_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator for tables that may have columns named like its inner ones, which all begin with `_`.

    Such columns of the first argument are set aside under other names and get their own back in the result.
    """

    @functools.wraps(operator)
    def shielded(docs: DataFrame, *args, **options) -> DataFrame:
        own = {c: unused(docs, f"own{i}{c}") for i, c in enumerate(docs.columns) if c.startswith("_")}
        result = operator(docs.withColumnsRenamed(own), *args, **options)
        return result.withColumnsRenamed({aside: c for c, aside in own.items()})

    return shielded


def buckets_for(rows: int, per_bucket: int = 20_000) -> int:
    """Number of hash buckets that keeps each at about `per_bucket` rows."""
    return max(1, -(-rows // per_bucket))


def running_total(df: DataFrame, group: str, order: str, value: str, into: str, buckets: int) -> DataFrame:
    """Add `into`: the sum of `value` over the rows of the group that stand before, by `order`.

    `order` is a hash (long). The group, however large, is cut into hash ranges: sums per range give
    each range its offset, and only the rows of one range are sorted in one task.
    """
    bits = (buckets - 1).bit_length()
    top = F.shiftright(F.col(order), 64 - bits) if bits else F.lit(0)  # keeps the sign, so ranges sort as hashes do
    rows = df.withColumn("_range", top.cast("int"))
    sums = rows.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    inner = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at"))
    # Stored, the offsets have a known size: Spark need not shuffle the rows to find that it can broadcast.
    return (
        rows.join(work_table(offsets), same)
        .withColumn(into, F.col("_offset") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop("_range", "_group", "_at", "_offset")
    )
