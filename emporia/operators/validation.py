"""Cross-validation whose folds share one scan: what a fold trains on is the total less the fold."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporia.operators.splits import bucket
from emporia.sources.store import work_table

WIDEST = "locality"  # the place column with most values; it is eliminated in Spark
NARROW = 4_000  # values of the other columns together, whose system is solved on the driver
TREES_AT_ONCE = 20  # a forest is fitted in parts, so that a task's binary does not hold all its trees
FITS_AT_ONCE = 8
TASK_ROWS = 50_000  # a task gathers figures for all open nodes, so small data should not be spread thin
ONE, LABEL = "", "revenue"  # keys of the intercept and of the label


def fold_rows(features: DataFrame, places: list[str], numbers: list[str], folds: int, seed: int) -> DataFrame:
    fold = bucket([*places, *numbers], seed, folds)
    return work_table(features.select(*places, *numbers, LABEL).withColumn("fold", fold))


def entries(places: list[str], numbers: list[str]) -> Column:
    """A row as (key, value) pairs: intercept, numbers, one per narrow place column, label."""
    narrow = [c for c in places if c != WIDEST]
    pairs = [(F.lit(ONE), F.lit(1.0))]
    pairs += [(F.lit(c), F.col(c).cast("double")) for c in [*numbers, LABEL]]
    pairs += [(F.concat(F.lit(f"{c}="), F.col(c)), F.lit(1.0)) for c in narrow]
    return F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in pairs])


def others(sums: DataFrame, keys: list[str], folds: int) -> DataFrame:
    """For every fold the sums over the rows of all other folds: the total less the fold's own."""
    total = sums.groupBy(*keys).agg(F.sum("v").alias("total"))
    every = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    left = every.join(sums, ["fold", *keys], "left")
    return left.select("fold", *keys, (F.col("total") - F.coalesce("v", F.lit(0.0))).alias("v"))


def pair_sums(rows: DataFrame, by: list[str], array: Column, scale: Column) -> DataFrame:
    """Σ scale · value_i · value_j for the keys i ≤ j of an array of (key, value), per `by`."""
    held = rows.select(*by, F.array_sort(array).alias("z"), scale.alias("scale"))
    first = held.select(*by, "scale", "z", F.posexplode("z").alias("at", "a"))
    both = first.select(*by, "scale", "a", F.explode(F.expr("slice(z, at + 1, size(z))")).alias("b"))
    product = F.col("scale") * F.col("a.value") * F.col("b.value")
    return both.groupBy(*by, F.col("a.key").alias("i"), F.col("b.key").alias("j")).agg(F.sum(product).alias("v"))


def ridge_weights(system: dict[tuple[str, str], float], moments: dict[tuple[str, str], float], alpha: float, numbers: list[str]) -> dict[str, float]:
    """Weights of the narrow keys from the reduced normal equations; the label has weight -1.

    The penalty is α · |w|² for numbers scaled to deviation 1: of the raw numbers, α times the variance.
    The intercept is free.
    """
    keys = sorted({k for pair in system for k in pair} - {LABEL})
    place = {k: n for n, k in enumerate(keys)}
    if len(keys) > NARROW:
        raise ValueError(f"{len(keys)} values of the narrow columns, more than {NARROW}")
    a, b = np.zeros((len(keys), len(keys))), np.zeros(len(keys))
    for (i, j), v in system.items():
        if i == LABEL or j == LABEL:
            other = j if i == LABEL else i
            if other != LABEL:
                b[place[other]] = v
        else:
            a[place[i], place[j]] = a[place[j], place[i]] = v
    n = moments[ONE, ONE]
    for k in keys:
        if k in numbers:
            a[place[k], place[k]] += alpha * (moments[k, k] / n - (moments[ONE, k] / n) ** 2)
        elif k != ONE:
            a[place[k], place[k]] += alpha
    return {**dict(zip(keys, np.linalg.lstsq(a, b, rcond=None)[0].tolist())), LABEL: -1.0}


def ridge_folds(rows: DataFrame, places: list[str], numbers: list[str], alpha: float, folds: int) -> DataFrame:
    """(fold, r2): ridge fitted exactly on the other folds and tested on the fold.

    `rows` are scanned twice, for sums per fold of the products of all pairs of columns and, per value
    of the widest column, of the columns. That column's block of the normal equations is diagonal, so
    it is eliminated value by value in Spark; what is left is as wide as the other columns and solved on
    the driver. Errors follow from the same sums. A value unseen in training has weight 0.
    """
    spark = rows.sparkSession
    z = entries(places, numbers)
    products = work_table(pair_sums(rows, ["fold"], z, F.lit(1.0)))
    flat = rows.select("fold", F.col(WIDEST).alias("wide"), F.explode(z).alias("z"))
    per_value = work_table(flat.groupBy("fold", "wide", F.col("z.key").alias("i")).agg(F.sum("z.value").alias("v")))
    train = work_table(others(products, ["i", "j"], folds))
    train_value = work_table(others(per_value, ["wide", "i"], folds))
    size = train_value.where(F.col("i") == ONE).select("fold", "wide", (F.col("v") + alpha).alias("size"))

    # Schur complement: what the widest column explains is taken off all products.
    rowwise = train_value.groupBy("fold", "wide").agg(F.collect_list(F.struct(F.col("i").alias("key"), F.col("v").alias("value"))).alias("z"))
    explained = pair_sums(rowwise.join(size, ["fold", "wide"]), ["fold"], F.col("z"), 1 / F.col("size"))
    reduced = train.unionByName(explained.withColumn("v", -F.col("v"))).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))

    def by_fold(sums: DataFrame) -> dict[int, dict[tuple[str, str], float]]:
        found: dict[int, dict] = {}
        for r in sums.collect():  # a matrix of the narrow columns per fold
            found.setdefault(r.fold, {})[r.i, r.j] = r.v
        return found

    moments = by_fold(train.where(F.col("i").isin(ONE, *numbers) & F.col("j").isin(ONE, *numbers)))
    systems = by_fold(reduced)
    weights = [
        (fold, key, w)
        for fold, system in systems.items()
        if moments[fold].get((ONE, ONE), 0) > 0
        for key, w in ridge_weights(system, moments[fold], alpha, numbers).items()
    ]
    beta = work_table(spark.createDataFrame(weights, "fold int, i string, w double"))
    # The weight of a value of the widest column, given the others: its mean residual, shrunk.
    own = (
        train_value.join(beta, ["fold", "i"]).groupBy("fold", "wide").agg(F.sum(F.col("v") * F.col("w")).alias("rest"))
        .join(size, ["fold", "wide"]).select("fold", "wide", (-F.col("rest") / F.col("size")).alias("u"))
    )

    other = beta.select("fold", F.col("i").alias("j"), F.col("w").alias("w2"))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    narrow = products.join(beta, ["fold", "i"]).join(other, ["fold", "j"]).select("fold", (twice * F.col("v") * F.col("w") * F.col("w2")).alias("e"))
    crossed = per_value.join(own, ["fold", "wide"]).join(beta, ["fold", "i"])
    wide = crossed.select("fold", (2 * F.col("u") * F.col("v") * F.col("w") + F.when(F.col("i") == ONE, F.col("v") * F.col("u") ** 2).otherwise(0.0)).alias("e"))
    errors = narrow.unionByName(wide).groupBy("fold").agg(F.sum("e").alias("error"))
    spread = products.groupBy("fold").agg(
        *[F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("v"))).alias(name) for i, j, name in ((ONE, ONE, "n"), (ONE, LABEL, "s"), (LABEL, LABEL, "q"))]
    )
    r2 = 1 - F.try_divide(F.col("error"), F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    return errors.join(spread, "fold").select("fold", r2.alias("r2"))


def coded(rows: DataFrame, places: list[str], numbers: list[str], folds: int) -> DataFrame:
    """For every fold all rows, with places as the mean revenue they have in the other folds.

    Trees split numbers by order, and the best split of a category orders its values by their mean, so one
    number per place column does for the one-hot width of all its values. Unseen values get the mean of
    the other folds.
    """
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in places], F.struct(F.lit("").alias("of"), F.lit("").alias("value"))))
    listed = rows.select("fold", LABEL, values.alias("z")).select("fold", LABEL, "z.*")
    sums = work_table(
        listed.groupBy("fold", "of", "value").agg(F.sum(LABEL).alias("y"), F.count("*").cast("double").alias("n"))
    )
    keys = ["of", "value"]
    y, n = [others(sums.withColumnRenamed(c, "v"), keys, folds).withColumnRenamed("v", c) for c in ("y", "n")]
    means = work_table(y.join(n, ["fold", *keys]).where("n > 0").select(F.col("fold").alias("test"), *keys, (F.col("y") / F.col("n")).alias("mean")))
    found = rows.withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    found = found.join(means.where("of = ''").select("test", F.col("mean").alias("overall")), "test")
    for c in places:
        own = means.where(F.col("of") == c).select("test", F.col("value").alias(c), F.col("mean").alias(f"{c}_mean"))
        found = found.join(own, ["test", c], "left")
    codes = [F.coalesce(f"{c}_mean", "overall").alias(f"{c}_code") for c in places]
    return found.select("test", "fold", LABEL, *numbers, *codes)


def forest_folds(rows: DataFrame, places: list[str], numbers: list[str], make, trees: int, folds: int) -> DataFrame:
    """(fold, r2) of a forest fitted on the other folds; `make(trees, seed)` gives an unfitted one.

    A forest is the mean of trees grown apart, so it is fitted in parts of TREES_AT_ONCE, several parts at a
    time, and its prediction is the weighted mean of theirs.
    """
    assembler = VectorAssembler(inputCols=[*numbers, *[f"{c}_code" for c in places]], outputCol="features")
    table = work_table(coded(rows, places, numbers, folds))
    tasks = max(1, rows.count() // TASK_ROWS)
    sizes = [min(TREES_AT_ONCE, trees - at) for at in range(0, trees, TREES_AT_ONCE)]

    def fit(job: tuple[int, int]):
        fold, part = job
        known = assembler.transform(table.where((F.col("test") == fold) & (F.col("fold") != fold)))
        return make(sizes[part], part).setFeaturesCol("features").setLabelCol(LABEL).fit(known.coalesce(tasks))

    jobs = [(fold, part) for fold in range(folds) for part in range(len(sizes))]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        models = dict(zip(jobs, pool.map(inheritable_thread_target(rows.sparkSession)(fit), jobs)))
    scored = []
    for fold in range(folds):
        tested = assembler.transform(table.where((F.col("test") == fold) & (F.col("fold") == fold)))
        for part, size in enumerate(sizes):
            tested = models[fold, part].setPredictionCol(f"p{part}").transform(tested)
        mean = reduce(lambda a, b: a + b, [F.col(f"p{i}") * (n / trees) for i, n in enumerate(sizes)])
        scored.append(tested.select("fold", LABEL, mean.alias("prediction")))
    return fold_r2(reduce(DataFrame.unionByName, scored))


def fold_r2(scored: DataFrame) -> DataFrame:
    error = F.col(LABEL) - F.col("prediction")
    sums = scored.groupBy("fold").agg(F.sum(error * error).alias("error"), (F.var_pop(LABEL) * F.count("*")).alias("all"))
    return sums.select("fold", (1 - F.try_divide("error", "all")).alias("r2"))
