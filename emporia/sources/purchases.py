"""Reading the semicolon-separated purchase file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emporia.schema import SOURCE_TO_CANONICAL

CORRUPT = "_corrupt_line"

# Texts the source's file reader takes for a missing value.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def normalized_name(header: str) -> str:
    """Trim, lower-case, blanks to underscores, repair one mis-decoded letter, no apostrophes."""
    name = header.strip().lower()
    for old, new in ((" ", "_"), ("ã©", "e"), ("'", "")):
        name = name.replace(old, new)
    return name


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalized_name(c) for c in df.columns])


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename normalised French headers to the engine's names; other columns stay."""
    return df.withColumnsRenamed({k: v for k, v in SOURCE_TO_CANONICAL.items() if k in df.columns})


def read_purchases(spark: SparkSession, path: str, sep: str = ";", multi_line: bool = False) -> DataFrame:
    """All-text rows of a purchase file with normalised headers.

    Lines with too many fields are dropped, lines with too few are padded with nulls. Spark marks
    both as corrupt, so the fields of a corrupt line are counted (separators outside quotes).
    """
    options = {"sep": sep, "header": "true", "multiLine": str(multi_line).lower(), "escape": '"'}
    headers = spark.read.options(**options).csv(path).columns
    fields = [T.StructField(h, T.StringType()) for h in headers]
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
        .schema(schema)
        .csv(path)
    )
    unquoted = F.regexp_replace(CORRUPT, '"([^"]|"")*"', "")
    n_fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep))) + 1
    kept = rows.where(F.col(CORRUPT).isNull() | (n_fields <= len(headers))).drop(CORRUPT)
    missing = [F.when(~F.col(f"`{h}`").isin(MISSING_TEXTS), F.col(f"`{h}`")).alias(h) for h in headers]
    return normalize_columns(kept.select(*missing))
