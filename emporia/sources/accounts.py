"""User accounts, read over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ACCOUNT_COLUMNS = ["id", "username", "email", "role", "is_active", "created_at", "last_login"]


def read_accounts(spark: SparkSession, url: str, table: str = "users", **options: str) -> DataFrame:
    """Account rows without the password hash; pass `user`, `password`, `driver` as options.

    `partitionColumn`, `lowerBound`, `upperBound` and `numPartitions` split a large table.
    """
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.select(*ACCOUNT_COLUMNS)
