"""High-value classification and segmentation of customers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporia.operators.splits import in_training
from emporia.sources.store import work_table

FEATURES = ["total_price", "quantity", "mean_spend"]
# Forest size and number of segments.
TREES, SEGMENTS = 100, 3
FIXED_POINT_ROUNDS = 100  # of k-means after the library's own


class Classifier(NamedTuple):
    model: PipelineModel
    metrics: DataFrame


def usable(features: DataFrame) -> DataFrame:
    """A client without quantity has no spend per unit; it counts as 0."""
    return features.fillna(0.0, subset=["mean_spend"])


def high_value_classifier(features: DataFrame, trees: int = TREES, seed: int = 42) -> Classifier:
    """Random forest for `high_value`, with its accuracy on a held-out fifth."""
    rows = work_table(usable(features).withColumn("is_train", in_training(["client_id"], seed)))
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="high_value", numTrees=trees, seed=seed
    )
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = Pipeline(stages=[assembler, forest]).fit(rows.where("is_train"))
    hit = (F.col("prediction") == F.col("high_value")).cast("double")
    metrics = model.transform(rows.where("NOT is_train")).agg(
        F.count("*").alias("test_size"), F.avg(hit).alias("accuracy")
    )
    return Classifier(model, metrics)


def predict_high_value(requests: DataFrame, model: PipelineModel) -> DataFrame:
    """(total, qty, prediction) for a table of requests; spend per unit is 0 at zero quantity."""
    ratio = F.coalesce(F.try_divide("total", "qty"), F.lit(0.0))
    ready = requests.withColumns(
        {
            "total_price": F.col("total").cast("double"),
            "quantity": F.col("qty").cast("double"),
            "mean_spend": ratio.cast("double"),
        }
    )
    return model.transform(ready).select("total", "qty", F.col("prediction").cast("int").alias("prediction"))


def segment_customers(features: DataFrame, k: int = SEGMENTS, seed: int = 42) -> DataFrame:
    """(client_id, cluster, squared_distance) by k-means on the unscaled features.

    Clusters are numbered from the centre of least spend on. The centres of the library's model are carried
    on to a fixed point: every client is in the cluster of the nearest centre, and every centre is the mean of its
    clients. Clients without a cluster there are none of; an empty table has no rows.
    """
    rows = work_table(usable(features).select("client_id", *FEATURES))
    if rows.isEmpty():
        return rows.select("client_id", F.lit(0).alias("cluster"), F.lit(0.0).alias("squared_distance"))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(assembled)
    centres = sorted(tuple(map(float, c)) for c in model.clusterCenters())
    for _ in range(FIXED_POINT_ROUNDS):
        found = nearest_centre(rows, centres)
        means = found.groupBy("cluster").agg(*[exact_mean(c) for c in FEATURES]).collect()  # k rows
        moved = sorted(tuple(r[c] for c in FEATURES) for r in means)
        if moved == centres:
            break
        centres = moved
    return nearest_centre(rows, centres).select("client_id", "cluster", "squared_distance")


def exact_mean(column: str) -> Column:
    """A mean that does not depend on the order of adding, so that a fixed point can be told."""
    return (F.sum(F.col(column).cast("decimal(28,6)")).cast("double") / F.count(column)).alias(column)


def squared_distance(centre: Column) -> Column:
    """From a client's features to a struct or array of them."""
    return sum((F.pow(F.col(c) - centre[i], 2) for i, c in enumerate(FEATURES)), F.lit(0.0))


def nearest_centre(rows: DataFrame, centres: list[tuple[float, ...]]) -> DataFrame:
    """`rows` with `cluster`, the number of the nearest centre (ties: the first), and `squared_distance`."""
    options = [
        F.struct(squared_distance(F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)
    ]
    best = F.array_min(F.array(*options))
    return rows.withColumn("best", best).select(*rows.columns, F.col("best.i").alias("cluster"), F.col("best.d").alias("squared_distance"))


def segment_residuals(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(client_id, excess, drift): a certificate of `found` (client_id, cluster, squared_distance).

    Centres are the means of the clusters' clients. `excess` is how much farther a client is from its own centre than
    from the nearest, `drift` how far its stated distance is off; both are relative to the distance.
    """
    placed = rows.join(found, "client_id")
    centres = placed.groupBy("cluster").agg(F.array(*[exact_mean(c) for c in FEATURES]).alias("centre"))
    every = centres.agg(F.collect_list("centre")).scalar()  # as many as there are clusters
    own = placed.join(centres, "cluster").withColumn("own", squared_distance(F.col("centre"))).withColumn("all", every)
    near = F.array_min(F.transform("all", squared_distance))
    scale = F.greatest(F.col("own"), F.lit(1.0))
    return own.select("client_id", ((F.col("own") - near) / scale).alias("excess"), (F.abs(F.col("own") - F.col("squared_distance")) / scale).alias("drift"))
