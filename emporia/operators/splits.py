"""Repeatable splits that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(keys: list[str], seed: int, n: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(n)).cast("int")


def in_training(keys: list[str], seed: int = 42, share: float = 0.8) -> Column:
    return bucket(keys, seed, 1000) < int(share * 1000)
