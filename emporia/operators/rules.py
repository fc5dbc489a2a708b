"""Frequent itemsets and association rules."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporia.schema import BASKET_KEYS
from emporia.sources.store import work_table

# Smallest support of an itemset, smallest lift of a rule, size of the small matrix.
MIN_SUPPORT, MIN_LIFT = 0.02, 1
MATRIX_BASKETS, MATRIX_ITEMS = 1000, 30


def presence(fact: DataFrame, keys: list[str], item: str = "product_name") -> DataFrame:
    """(keys, item, present): present when the quantities of the item in the basket sum above 0.

    Rows with present = false keep baskets whose items were all returned, which count in N.
    """
    return (
        fact.dropna(subset=[*keys, item])
        .groupBy(*keys, F.col(item).alias("item"))
        .agg((F.sum("quantity") > 0).alias("present"))
    )


def baskets_by(fact: DataFrame, keys: list[str], item: str = "product_name") -> DataFrame:
    """(keys, items): the present items of each basket, sorted; all-returned baskets are empty."""
    here = F.when(F.col("present"), F.col("item"))
    return (
        presence(fact, keys, item).groupBy(*keys).agg(F.array_sort(F.collect_list(here)).alias("items"))
    )


def baskets_by_client(fact: DataFrame) -> DataFrame:
    return baskets_by(fact, ["client_id"])


def baskets_by_date(fact: DataFrame) -> DataFrame:
    return baskets_by(fact, ["purchase_date"])


def cap_matrix(
    matrix: DataFrame, key: str, baskets: int | None = None, items: int | None = None
) -> DataFrame:
    """The corner of the basket × item matrix: first baskets and first items in text order.

    Without numbers the whole matrix stays.
    """
    if baskets is not None:
        first = matrix.select(key).distinct().orderBy(F.col(key).cast("string")).limit(baskets)
        matrix = matrix.join(first, key, "left_semi")
    if items is not None:
        first = matrix.select("item").distinct().orderBy("item").limit(items)
        matrix = matrix.join(first, "item", "left_semi")
    return matrix


def frequent_itemsets(
    matrix: DataFrame,
    keys: list[str] | None = None,
    min_support: float = MIN_SUPPORT,
    max_len: int | None = None,
) -> DataFrame:
    """(items, count, n, support) of every itemset in at least `min_support` of the N baskets.

    `matrix` has the basket keys, `item` and, if returns matter, `present`. Equal baskets fold into
    one weighted set before anything is counted. Infrequent items go first; then itemsets grow one
    item at a time: a set keeps the items after its last one, equal rests fold together, and only
    frequent sets grow. What is stored per level is pruned to the frequent sets, and the loop ends at
    the first level without one.
    """
    keys = keys or BASKET_KEYS
    item = F.when(F.col("present"), F.col("item")) if "present" in matrix.columns else F.col("item")
    folded = work_table(
        matrix.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("rest"))
        .groupBy("rest").agg(F.count("*").alias("w"))
    )
    n = folded.agg(F.sum("w")).scalar()
    needed = min_support * F.col("n")

    numbered = folded.withColumn("set", F.monotonically_increasing_id())
    items = numbered.select("set", "w", F.explode("rest").alias("item"))
    frequent_items = work_table(
        items.groupBy("item").agg(F.sum("w").alias("c")).withColumn("n", n)
        .where(F.col("c") >= needed).select("item", "n")
    )
    state = (
        items.join(frequent_items, "item")
        .groupBy("set", "w", "n")
        .agg(F.array_sort(F.collect_list("item")).alias("rest"))
        .groupBy("rest", "n")
        .agg(F.sum("w").alias("w"))
        .withColumn("items", F.array().cast("array<string>"))
    )
    found: DataFrame | None = None
    size = 0
    while max_len is None or size < max_len:
        size += 1
        grown = (
            state.select("items", "rest", "n", "w", F.posexplode("rest").alias("at", "next"))
            .select(
                F.array_append("items", F.col("next")).alias("items"),
                F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"),
                "n",
                "w",
            )
            .groupBy("items", "rest", "n")
            .agg(F.sum("w").alias("w"))
        )
        level = work_table(
            grown.groupBy("items", "n").agg(F.sum("w").alias("count")).where(F.col("count") >= needed)
        )
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            break
        state = work_table(grown.where(F.size("rest") > 0).join(level.select("items"), "items", "left_semi"))
    return found.select("items", "count", "n", (F.col("count") / F.col("n")).alias("support"))


def fp_itemsets(baskets: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """The same itemsets by FP-growth over (items) arrays, for sparse baskets of any length."""
    baskets = work_table(baskets.select("items"))
    n = baskets.agg(F.count("*")).scalar()
    model = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets)
    return model.freqItemsets.select(
        F.array_sort("items").alias("items"),
        F.col("freq").alias("count"),
        n.alias("n"),
        (F.col("freq") / n).alias("support"),
    )


def association_rules(itemsets: DataFrame, min_lift: float = MIN_LIFT) -> DataFrame:
    """Every split of an itemset into antecedent and consequent with lift of at least `min_lift`.

    Consequents may hold several items, which Spark's own rules do not offer. A split is a bit
    mask over the sorted items, so both sides stay sorted and find their supports by equality. An
    itemset has 2^size - 2 splits; one of more than 30 items, which has over a billion, is refused.
    """
    sets = itemsets.where(F.size("items") >= 2)
    masks = F.when(
        F.size("items") <= 30, F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size("items")) - 2).cast("int"))
    ).otherwise(F.raise_error(F.lit("an itemset of more than 30 items has too many rules; raise the support")))
    split = sets.withColumn("mask", F.explode(masks)).select(
        F.expr("filter(items, (v, i) -> (shiftright(mask, i) & 1) = 1)").alias("antecedents"),
        F.expr("filter(items, (v, i) -> (shiftright(mask, i) & 1) = 0)").alias("consequents"),
        F.col("count").alias("joint"),
        "n",
    )
    of_antecedent = itemsets.select(F.col("items").alias("antecedents"), F.col("count").alias("_a"))
    of_consequent = itemsets.select(F.col("items").alias("consequents"), F.col("count").alias("_c"))
    joined = split.join(of_antecedent, "antecedents").join(of_consequent, "consequents")
    n, joint = F.col("n"), F.col("joint").cast("double")
    product = F.col("_a").cast("double") * F.col("_c")
    support_a, support_c, support = F.col("_a") / n, F.col("_c") / n, joint / n
    confidence = joint / F.col("_a")
    conviction = F.when(F.col("joint") == F.col("_a"), F.lit(float("inf"))).otherwise(
        F.try_divide(1 - support_c, 1 - confidence)
    )
    return joined.where(joint * n >= min_lift * product).select(
        "antecedents",
        "consequents",
        support_a.alias("antecedent_support"),
        support_c.alias("consequent_support"),
        support.alias("support"),
        confidence.alias("confidence"),
        (joint * n / product).alias("lift"),
        (support - support_a * support_c).alias("leverage"),
        conviction.alias("conviction"),
    )


def bundles(rules: DataFrame, n: int | None = 10) -> DataFrame:
    """Rules as (items, recommended, confidence), best lift first, then support and items."""
    ordered = rules.orderBy(F.desc("lift"), F.desc("support"), "antecedents", "consequents")
    kept = ordered.limit(n) if n else ordered
    return kept.select(
        F.col("antecedents").alias("items"), F.col("consequents").alias("recommended"), "confidence", "lift"
    )
