"""Connected components of an undirected graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporia.sources.store import work_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node it can reach.

    Each round sends every node to its smallest neighbour's smallest neighbour and rewrites the edges
    between what is left, so that whole neighbourhoods fold at once; the rounds' maps are then
    followed one after the other. Sums over neighbours combine before the shuffle, so a node with very
    many neighbours does not gather them. Each round is written, which cuts the lineage.
    Loops and repeated edges are allowed; no edges give no rows.
    """
    links = work_table(_tidy(edges))
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("b"))
        parents = work_table(nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        step = work_table(_follow(parents, parents))
        rounds.append(step)
        moved = links
        for end in ("a", "b"):
            moved = (
                moved.join(step, F.col(end) == F.col("node"))
                .withColumn(end, F.col("root"))
                .drop("node", "root")
            )
        links = work_table(_tidy(moved))
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    result = rounds[0]
    for step in rounds[1:]:
        result = _follow(result, step)
    return result


def _tidy(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ends.where("a <> b").distinct()


def _follow(first: DataFrame, then: DataFrame) -> DataFrame:
    onward = then.select(F.col("node").alias("_at"), F.col("root").alias("_next"))
    return first.join(onward, F.col("root") == F.col("_at"), "left").select(
        "node", F.coalesce("_next", "root").alias("root")
    )
