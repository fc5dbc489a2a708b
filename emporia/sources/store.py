"""Tables and models kept in shared storage."""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = _local_folder()
    return folder


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="emporia-")


_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def scratch_path(spark: SparkSession) -> str:
    """A fresh path for intermediate data, in the current run folder if there is one."""
    parent = _RUN.get() or f"{shared_dir(spark).rstrip('/')}/emporia"
    return f"{parent}/{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Work tables made in this block go to one folder, which is removed at its end.

    What the block needs of their contents must be written or collected before it ends.
    """
    path = scratch_path(spark)
    token = _RUN.set(path)
    try:
        yield path
    finally:
        _RUN.reset(token)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def work_table(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write an intermediate table once and read it back; `run_folder` removes it.

    Cuts the lineage, survives the loss of executors, and gives the planner a measured size to
    decide on broadcasts with.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def write_fact(fact: DataFrame, path: str) -> None:
    """Save the cleaned fact by purchase year; the hint lets Spark split large years over tasks."""
    (
        fact.withColumn("purchase_year", F.year("purchase_date"))
        .hint("rebalance", "purchase_year")
        .write.mode("overwrite")
        .partitionBy("purchase_year")
        .parquet(path)
    )


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: MLWritable, metrics: DataFrame | None, path: str) -> None:
    """Persist a fitted pipeline and its metrics table next to each other."""
    model.write().overwrite().save(f"{path}/model")
    if metrics is not None:
        metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    # Written last: says that the model is whole, and whether it has metrics.
    spark = SparkSession.active()
    spark.range(1).select(F.lit(metrics is not None).alias("has_metrics")).write.mode("overwrite").parquet(f"{path}/whole")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame | None]:
    has_metrics = spark.read.schema("has_metrics boolean").parquet(f"{path}/whole").first()[0]
    metrics = spark.read.parquet(f"{path}/metrics") if has_metrics else None
    return PipelineModel.load(f"{path}/model"), metrics


def model_exists(spark: SparkSession, path: str) -> bool:
    """True for a model that was written to the end."""
    try:
        return spark.read.schema("has_metrics boolean").parquet(f"{path}/whole").count() == 1
    except AnalysisException:
        return False


def load_or_train(spark: SparkSession, path: str, train) -> tuple[PipelineModel, DataFrame]:
    """Reload a saved model, or call `train() -> (model, metrics)` and save what it gives."""
    if not model_exists(spark, path):
        save_model(*train(), path)
    return load_model(spark, path)


def fingerprint(rows: DataFrame, *settings) -> str:
    """A name for the contents of a table, whatever the order of its rows, and for settings.

    Numbers count to six decimals, so that sums added in another order are the same.
    """
    columns = [F.round(c, 6) if kind == "double" else F.col(c) for c, kind in sorted(rows.dtypes)]
    held = rows.select(F.xxhash64(*columns).alias("h"))
    n, mixed, total = held.agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((sorted(rows.dtypes), n, mixed, total, settings)).encode()).hexdigest()[:24]


def versioned_model(rows: DataFrame, name: str, train, *settings) -> tuple[PipelineModel, DataFrame | None]:
    """The model that `train() -> (model, metrics)` makes of `rows`, from the store if it has that version.

    A version is named by the fingerprint of the training rows and the settings: other data give another
    model. It is written aside and appears by one rename, so a reader never sees half of it.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/emporia/models/{name}-{fingerprint(rows, *settings)}"
    if not model_exists(spark, path):
        aside = f"{path}.{uuid.uuid4().hex}"
        save_model(*train(), aside)
        source, target = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, path)]
        files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(target) or not files.rename(source, target):
            files.delete(source, True)  # another session was first
    return load_model(spark, path)
