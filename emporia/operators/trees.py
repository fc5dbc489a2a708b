"""Fitted tree ensembles as tables of nodes, and what can be told from the tables alone."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporia.sources.store import scratch_path, work_table

NODE = (
    "tree int, weight double, node int, feature int, threshold double, values array<double>, is_category boolean, "
    "left_node int, right_node int, prediction double, votes array<double>, gain double, cover double"
)

LEVELS_AT_ONCE = 3


def node_table(spark, model: PipelineModel) -> DataFrame:
    """The nodes of the ensemble that ends a pipeline, as NODE says: a row each, read from the saved model.

    An inner node sends a row left if its feature is at most `threshold` or, for a category, one of
    `values`. Leaves have no feature. `votes` are a classifier's class weights, `cover` the training rows.
    """
    path = scratch_path(spark)
    model.stages[-1].write().save(path)
    trees = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").drop("metadata")
    data = spark.read.parquet(f"{path}/data")
    node, split = "nodeData.", "nodeData.split."
    is_category, inner = F.col(f"{split}numCategories") >= 0, F.col(f"{split}featureIndex") >= 0
    cuts = F.col(f"{split}leftCategoriesOrThreshold")
    rows = data.join(trees, "treeID").select(
        F.col("treeID").cast("int").alias("tree"),
        F.col("weights").cast("double").alias("weight"),
        F.col(f"{node}id").alias("node"),
        F.when(inner, F.col(f"{split}featureIndex")).alias("feature"),
        F.when(inner & ~is_category, F.get(cuts, F.lit(0))).alias("threshold"),
        F.when(inner & is_category, cuts).alias("values"),
        is_category.alias("is_category"),
        F.col(f"{node}leftChild").alias("left_node"),
        F.col(f"{node}rightChild").alias("right_node"),
        F.col(f"{node}prediction").alias("prediction"),
        F.col(f"{node}impurityStats").alias("votes"),
        F.col(f"{node}gain").alias("gain"),
        F.col(f"{node}rawCount").cast("double").alias("cover"),
    )
    return work_table(rows)


def leaves_reached(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(row, tree, weight, prediction, votes): the leaf of every tree for `rows` (row, x: array<double>).

    One join per level: every row goes to a child of where it is, until it stands at a leaf. `depth` is
    the most levels that a tree may have. Places are stored every few levels, which keeps the plan short.
    """
    number_of_trees = nodes.agg(F.max("tree")).scalar()
    places = F.explode(F.sequence(F.lit(0), number_of_trees)).alias("tree")
    at = rows.select("row", places, F.lit(0).alias("node"))
    steps = work_table(
        nodes.where("feature IS NOT NULL")
        .select("tree", "node", "feature", "threshold", F.when(F.col("is_category"), F.col("values")).alias("values"), "left_node", "right_node")
    )
    for level in range(depth):
        value = F.get("x", F.col("feature"))
        goes_left = F.when(F.col("values").isNotNull(), F.array_contains("values", value)).otherwise(value <= F.col("threshold"))
        child = F.when(goes_left, F.col("left_node")).otherwise(F.col("right_node"))
        moved = at.join(steps, ["tree", "node"], "left").join(rows, "row")
        at = moved.select("row", "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(child).alias("node"))
        if level % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1:
            at = work_table(at)
    leaves = nodes.select("tree", "node", "weight", "prediction", "votes")
    return at.join(leaves, ["tree", "node"]).select("row", "tree", "weight", "prediction", "votes")


def scored_by_nodes(rows: DataFrame, nodes: DataFrame, kind: str, depth: int) -> DataFrame:
    """(row, prediction) for `rows` (row, x), from the node table alone.

    `kind`: "mean" for forests of numbers, "sum" for boosted trees, "vote" for forests of classes, where each
    tree's leaf gives shares that add up to 1 and the largest sum wins (ties: the first class).
    """
    leaves = leaves_reached(rows, nodes, depth)
    if kind == "vote":
        share = leaves.select("row", F.posexplode("votes").alias("class", "v"), F.aggregate("votes", F.lit(0.0), lambda a, b: a + b).alias("all"))
        sums = share.groupBy("row", "class").agg(F.sum(F.try_divide("v", "all")).alias("s"))
        best = F.max_by("class", F.struct(F.round("s", 9), -F.col("class")))
        return sums.groupBy("row").agg(best.cast("double").alias("prediction"))
    total = F.sum(F.col("weight") * F.col("prediction"))
    return leaves.groupBy("row").agg((total / F.sum("weight") if kind == "mean" else total).alias("prediction"))


def importances_by_nodes(nodes: DataFrame) -> DataFrame:
    """(feature, importance): each tree's gains times covers, shares of the tree, averaged and made shares again."""
    gains = nodes.where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("cover")).alias("g"))
    totals = gains.groupBy("tree").agg(F.sum("g").alias("all"))
    shares = gains.join(totals, "tree").groupBy("feature").agg(F.sum(F.try_divide("g", "all")).alias("s"))
    return shares.select("feature", F.try_divide(F.col("s"), shares.agg(F.sum("s")).scalar()).alias("importance"))


def with_cells(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add `_cell`: `features` as far as the nodes can tell. Rows of one cell reach the same leaf of every tree.

    A number becomes the least threshold of its feature that is not below it, infinity above all of them; a
    category stays; a feature that no node asks for is infinity. A feature has fewer thresholds than
    training had bins, so with few features there are far fewer cells than rows.
    """
    by_feature = (
        nodes.where("feature IS NOT NULL")
        .groupBy("feature")
        .agg(F.struct(F.collect_set("threshold").alias("cuts"), F.bool_or("is_category").alias("whole")).alias("asked"))
    )
    asked = by_feature.agg(F.map_from_entries(F.collect_list(F.struct("feature", "asked")))).scalar()

    def cell(value: Column, feature: Column) -> Column:
        own = F.try_element_at("_asked", feature)
        above = F.array_min(F.filter(own["cuts"], lambda cut: cut >= value))
        return F.when(own["whole"], value).otherwise(F.coalesce(above, F.lit(float("inf"))))

    placed = rows.withColumn("_asked", asked).withColumn("_cell", F.transform(vector_to_array("features"), cell))
    return placed.drop("_asked")


class NodeModel:
    """A fitted pipeline whose last stage is scored from its node table, with joins instead of the library.

    Operators take it in place of the pipeline; what both give is compared to tell whether a model was
    stored, read and applied as it should be. `kind` as in `scored_by_nodes`. Rows that no node tells apart
    walk the trees once.
    """

    def __init__(self, spark, model: PipelineModel, kind: str):
        self.features = PipelineModel(model.stages[:-1])
        self.nodes = node_table(spark, model)
        self.depth = model.stages[-1].getOrDefault("maxDepth")
        self.kind = kind

    def transform(self, df: DataFrame) -> DataFrame:
        rows = work_table(with_cells(self.features.transform(df), self.nodes))
        asked = work_table(rows.select(F.col("_cell").alias("x")).distinct().withColumn("row", F.monotonically_increasing_id()))
        found = scored_by_nodes(asked, self.nodes, self.kind, self.depth)
        of_cell = work_table(asked.join(found, "row").select(F.col("x").alias("_cell"), "prediction"))
        return rows.join(of_cell, "_cell").drop("_cell")


def distance(own: DataFrame, other: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, distance): how far `value` is apart in two tables, relative to its size, to six decimals.

    A key that only one of them has, or a value that only one gives, has distance null.
    """
    both = own.select(*keys, F.col(value).alias("_own"), F.lit(True).alias("_here")).join(
        other.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_other"), F.lit(True).alias("_there")),
        [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys],
        "full",
    )
    apart = F.abs(F.col("_own") - F.col("_other")) / F.greatest(F.abs("_own"), F.lit(1.0))
    same = F.when(F.col("_own").isNull() & F.col("_other").isNull() & F.col("_here") & F.col("_there"), F.lit(0.0))
    names = [F.coalesce(k, f"_{k}").alias(k) for k in keys]
    return both.select(*names, F.coalesce(F.round(apart, 6), same).alias("distance"))
