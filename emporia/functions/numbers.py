from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even, as Python's `round` does.

    Spark's own `round` and `bround` work on the shortest decimal text of the number, so they
    turn 35.15 into 35.2; the JVM number formatter looks at the binary value and gives 35.1.
    """
    pattern = "0." + "0" * digits if digits else "0"
    number = value.cast("double")
    finite = F.when(F.abs(number) < float("inf"), number)
    text = F.call_function("format_number", finite, F.lit(pattern))
    return F.coalesce(text.cast("double"), number) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0


def cents(value: Column) -> Column:
    """Money at two decimals; removes the last-digit noise of float sums."""
    return F.round(value, 2)
