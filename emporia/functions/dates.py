from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season labels and the months they cover; other months are autumn.
WINTER, SPRING, SUMMER, AUTUMN = "Hiver", "Printemps", "Été", "Automne"


def season(date: Column) -> Column:
    month = F.month(date)
    return (
        F.when(month.isin(12, 1, 2), WINTER)
        .when(month.between(3, 5), SPRING)
        .when(month.between(6, 8), SUMMER)
        .otherwise(AUTUMN)
    )


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")
