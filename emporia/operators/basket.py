"""Which products are bought together, and what that says about where to put them.

N is the number of baskets, s(x) the baskets holding x, f(x, y) the baskets holding both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emporia.functions.numbers import py_round
from emporia.operators.lookup import filter_slice, match_product_name
from emporia.operators.topk import ranked_within
from emporia.schema import BASKET_KEYS
from emporia.sources.store import work_table

# Thresholds of the placement, layout and pair rules, and the class labels.
APART_LIFT, APART_CONFIDENCE = 1.5, 10
CLOSE_LIFT, CLOSE_WEAK_LIFT, CLOSE_WEAK_CONFIDENCE = 0.8, 1, 5
LAYOUT_APART_LIFT, LAYOUT_APART_CONFIDENCE = 1.1, 5
LAYOUT_NEGATIVE_LIFT, LAYOUT_NEGATIVE_CONFIDENCE = 0.9, 3
ACTION_CLOSE_LIFT, ACTION_FREE_LIFT = 0.85, 0.95
STRONG_SCORE, OFTEN_SCORE, MODERATE_SCORE = 50, 20, 5
APART, CLOSE, NEUTRAL = "a_eloigner", "a_rapprocher", "neutres"

# A basket with more distinct items than this is cut into blocks of about this many.
BLOCK_ITEMS = 256


def named_rows(fact: DataFrame, item: str = "product_name", by: list[str] | None = None) -> DataFrame:
    """(by, basket, item) of every purchase with names trimmed; a missing or empty name is a null item, so
    that a basket without any usable item still counts."""
    keys = [*(by or []), *BASKET_KEYS]
    name = F.nullif(F.trim(item), F.lit(""))
    return fact.dropna(subset=BASKET_KEYS).select(*keys, name.alias("item"))


def item_rows(fact: DataFrame, item: str = "product_name", by: list[str] | None = None) -> DataFrame:
    """`named_rows` without missing and empty names."""
    return named_rows(fact, item, by).where("item IS NOT NULL")


def basket_items(fact: DataFrame, item: str = "product_name", by: list[str] | None = None) -> DataFrame:
    """Distinct (basket, item); names are trimmed, missing and empty ones dropped."""
    return item_rows(fact, item, by).distinct()


def basket_table(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stored (by, items, size): one row per basket with its sorted distinct items.

    `rows` are `named_rows` or `item_rows`, repeated or not. They are shuffled once: repeated purchases are gone from what a task sends of a
    basket, which is no longer than the catalogue. Supports, pair counts and N all come from
    narrow scans of this table instead of further shuffles of the purchases.
    """
    by = by or []
    baskets = rows.groupBy(*by, *BASKET_KEYS).agg(F.sort_array(F.collect_set("item")).alias("items"))
    return work_table(baskets.select(*by, "items", F.size("items").alias("size")))


def basket_count(baskets: DataFrame) -> Column:
    """N, the number of baskets of a basket table, as a scalar."""
    return baskets.agg(F.count("*")).scalar()


def item_support(baskets: DataFrame) -> DataFrame:
    """(item, support, n) of a basket table: s(item), and N."""
    support = baskets.select(F.explode("items").alias("item")).groupBy("item")
    return support.agg(F.count("*").alias("support")).withColumn("n", basket_count(baskets))


def ordered_pairs(baskets: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, x, y) for all x < y of each row's sorted `items`, one row at a time."""
    firsts = baskets.select(*keep, "items", F.posexplode("items").alias("_at", "x"))
    rest = F.slice("items", F.col("_at") + 2, F.size("items"))
    return firsts.select(*keep, "x", F.explode(rest).alias("y"))


def pair_counts(baskets: DataFrame, by: list[str] | None = None, block: int = BLOCK_ITEMS) -> DataFrame:
    """f(x, y) for x < y over a basket table.

    A usual basket yields its pairs in place and they are summed before the only shuffle, by pair.
    A basket of more than `block` items is cut into blocks, and its pairs of blocks are spread over
    tasks, so no task holds more than a few blocks of one basket however large that is. `size` is a
    stored column, so looking for such baskets skips the parts of the table without any.
    """
    by = by or []
    small = ordered_pairs(baskets.where(F.col("size").between(2, block)), by)

    last = F.ceil(F.col("size") / block).cast("int") - 1
    blocks = (
        baskets.where(F.col("size") > block)
        .select(*by, "items", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_a"))
        .select(*by, "items", "_a", F.explode(F.sequence("_a", "_last")).alias("_b"))
        .select(
            *by,
            (F.col("_a") == F.col("_b")).alias("_same"),
            F.slice("items", F.col("_a") * block + 1, F.lit(block)).alias("_left"),
            F.slice("items", F.col("_b") * block + 1, F.lit(block)).alias("_right"),
        )
        .repartition(F.xxhash64("_left", "_right"))
    )
    large = (
        blocks.select(*by, "_same", "_right", F.explode("_left").alias("x"))
        .select(*by, "_same", "x", F.explode("_right").alias("y"))
        .where("NOT _same OR x < y")
        .select(*by, "x", "y")
    )
    return small.unionByName(large).groupBy(*by, "x", "y").agg(F.count("*").alias("frequency"))


def top_pairs(
    fact: DataFrame, category: str | None = None, delegation: str | None = None, n: int = 5
) -> DataFrame:
    """The most frequent pairs in a slice."""
    pairs = pair_counts(basket_table(item_rows(filter_slice(fact, category, delegation))))
    return pairs.orderBy(F.desc("frequency"), "x", "y").limit(n)


def with_metrics(pairs: DataFrame, support: DataFrame) -> DataFrame:
    """Add supports, confidence x→y in percent, expected frequency and lift to counted pairs.

    `support` has (item, support, n), as `item_support` gives it.
    """
    of_x = support.select(F.col("item").alias("x"), F.col("support").alias("support_x"), "n")
    of_y = support.select(F.col("item").alias("y"), F.col("support").alias("support_y"))
    joined = pairs.join(of_x, "x").join(of_y, "y")
    product = F.col("support_x").cast("double") * F.col("support_y")
    return (
        joined.withColumn("confidence", F.col("frequency") / F.col("support_x") * 100)
        .withColumn("expected", product / F.col("n"))
        .withColumn("lift", F.col("frequency") / F.col("expected"))
    )


def pair_metrics(fact: DataFrame, item: str = "product_name") -> DataFrame:
    baskets = basket_table(item_rows(fact, item))
    return with_metrics(pair_counts(baskets), work_table(item_support(baskets)))


def save_basket_tables(fact: DataFrame, path: str) -> None:
    """Keep item supports and pair counts, so that later questions need no purchases."""
    baskets = basket_table(item_rows(fact))
    item_support(baskets).write.mode("overwrite").parquet(f"{path}/item_support")
    pair_counts(baskets).write.mode("overwrite").parquet(f"{path}/pair_counts")


def load_basket_tables(spark: SparkSession, path: str) -> DataFrame:
    """`pair_metrics` from saved tables."""
    return with_metrics(
        spark.read.parquet(f"{path}/pair_counts"), spark.read.parquet(f"{path}/item_support")
    )


def association_score(confidence: Column, lift: Column, frequency: Column) -> Column:
    """Confidence × lift, boosted by the logarithm of the frequency for positive association."""
    return F.when(lift >= 1, confidence * lift * F.log1p(frequency)).otherwise(confidence * lift)


def placement_pairs(
    fact: DataFrame, category: str | None = None, delegation: str | None = None
) -> DataFrame:
    """Every pair of a slice with its score and placement class.

    Classes come from unrounded figures; the columns hold the rounded ones, by which lists are
    sorted. N counts every basket of the slice, single-item ones included.
    """
    baskets = basket_table(named_rows(filter_slice(fact, category, delegation)))
    confidence, lift = F.col("confidence"), F.col("lift")
    placed = (
        F.when((lift >= APART_LIFT) & (confidence >= APART_CONFIDENCE), APART)
        .when(
            (lift < CLOSE_LIFT) | ((lift < CLOSE_WEAK_LIFT) & (confidence < CLOSE_WEAK_CONFIDENCE)), CLOSE
        )
        .otherwise(NEUTRAL)
    )
    return with_metrics(pair_counts(baskets), work_table(item_support(baskets))).select(
        "x",
        "y",
        "frequency",
        py_round(confidence, 1).alias("confidence"),
        py_round(lift, 2).alias("lift"),
        py_round(association_score(confidence, lift, F.col("frequency")), 2).alias("score"),
        placed.alias("class"),
    )


def rank_placement(pairs: DataFrame, n: int) -> DataFrame:
    """First n per class: the strongest lifts to keep apart, the weakest to bring together."""
    direction = F.when(F.col("class") == APART, -F.col("lift")).otherwise(F.col("lift"))
    return ranked_within(pairs, ["class"], [direction, F.col("x"), F.col("y")], n)


def placement(
    fact: DataFrame,
    category: str | None = None,
    delegation: str | None = None,
    n: int = 10,
    with_neutral: bool = False,
) -> DataFrame:
    """Pairs to keep apart and pairs to bring together, n of each.

    Neutral pairs are listed on request, the weakest lifts first.
    """
    pairs = placement_pairs(fact, category, delegation)
    return rank_placement(pairs if with_neutral else pairs.where(F.col("class") != NEUTRAL), n)


def placement_tips(ranked: DataFrame, n: int = 3) -> DataFrame:
    """(class, products): the first n pairs of each class of `placement`, as one text."""
    label = F.concat_ws(" + ", "x", "y")
    return (
        ranked.where((F.col("class") != NEUTRAL) & (F.col("rank") <= n))
        .groupBy("class")
        .agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))).alias("_pairs"))
        .select("class", F.array_join(F.transform("_pairs", lambda p: p["label"]), ", ").alias("products"))
    )


def layout_pairs(fact: DataFrame) -> DataFrame:
    """Category pairs over the baskets with at least two categories, classified.

    Baskets with equal category sets are folded into one weighted set before pairs are made: there
    are few categories, so few sets, however many baskets.
    """
    sets = (
        fact.dropna(subset=[*BASKET_KEYS, "category"])
        .groupBy(*BASKET_KEYS)
        .agg(F.array_sort(F.collect_set("category")).alias("items"))
        .where(F.size("items") >= 2)
        .groupBy("items")
        .agg(F.count("*").alias("weight"))
    )
    sets = work_table(sets)
    support = (
        sets.select(F.explode("items").alias("item"), "weight")
        .groupBy("item")
        .agg(F.sum("weight").alias("support"))
        .withColumn("n", sets.agg(F.sum("weight")).scalar())
    )
    pairs = ordered_pairs(sets, ["weight"]).groupBy("x", "y").agg(F.sum("weight").alias("frequency"))
    lift, confidence = F.col("lift"), F.col("confidence")
    apart = (lift >= LAYOUT_APART_LIFT) & (confidence >= LAYOUT_APART_CONFIDENCE)
    negative = (lift < LAYOUT_NEGATIVE_LIFT) | (confidence < LAYOUT_NEGATIVE_CONFIDENCE)
    return with_metrics(pairs, support).select(
        "x", "y", "frequency", "confidence", "lift",
        F.when(apart, APART).otherwise(CLOSE).alias("class"),
        F.when(apart, "positive").when(negative, "negative").otherwise("neutral").alias("association"),
    )


def layout(fact: DataFrame, n: int = 10) -> DataFrame:
    return rank_placement(layout_pairs(fact), n)


def layout_action(ranked: DataFrame) -> DataFrame:
    """The shown list: both layout lists by rising lift, with an action per pair."""
    action = (
        F.when(F.col("lift") < ACTION_CLOSE_LIFT, "À rapprocher")
        .when(F.col("lift") < ACTION_FREE_LIFT, "Placement libre")
        .otherwise("À éloigner")
    )
    return ranked.select("x", "y", "lift", action.alias("action")).orderBy("lift", "x", "y")


def analyze_pairs(
    fact: DataFrame, pairs: DataFrame, category: str | None = None, delegation: str | None = None
) -> DataFrame:
    """Association of each asked (product_1, product_2), both names resolved first.

    One row per distinct pair; `missing` lists the names without a match, whose pair has zero
    counts. Only rows of the asked products are paired.
    """
    asked = work_table(pairs.select("product_1", "product_2").distinct())
    texts = asked.select(F.col("product_1").alias("query")).unionByName(
        asked.select(F.col("product_2").alias("query"))
    )
    matches = work_table(match_product_name(texts, fact))
    resolved = asked.join(
        matches.select(F.col("query").alias("product_1"), F.col("matched").alias("matched_1")),
        "product_1", "left",
    ).join(
        matches.select(F.col("query").alias("product_2"), F.col("matched").alias("matched_2")),
        "product_2", "left",
    )
    wanted = matches.select(F.trim("matched").alias("_wanted")).where("_wanted <> ''").distinct()
    # Names nobody asked for become one null per basket: it still counts, but pairs nothing.
    rows = (
        filter_slice(fact, category, delegation)
        .join(wanted, F.trim("product_name") == F.col("_wanted"), "left")
        .withColumn("product_name", F.col("_wanted"))
    )
    baskets = basket_table(named_rows(rows))
    support = work_table(item_support(baskets))
    return score_pairs(resolved, support, pair_counts(baskets), basket_count(baskets))


def score_pairs(resolved: DataFrame, support: DataFrame, counts: DataFrame, n: Column) -> DataFrame:
    """Counts, rounded metrics and tier of resolved pairs, from item supports and pair counts."""
    one, two = F.col("matched_1"), F.col("matched_2")
    known = one.isNotNull() & two.isNotNull()
    joined = (
        resolved.join(support.select(F.col("item").alias("matched_1"), F.col("support").alias("_s1")), "matched_1", "left")
        .join(support.select(F.col("item").alias("matched_2"), F.col("support").alias("_s2")), "matched_2", "left")
        .withColumn("x", F.least(one, two))
        .withColumn("y", F.greatest(one, two))
        .join(counts, ["x", "y"], "left")
        .withColumn("_n", n)
    )
    zero = F.lit(0).cast("bigint")
    counted = joined.select(
        "product_1", "product_2", "matched_1", "matched_2",
        F.when(known, F.coalesce("_s1", zero)).otherwise(zero).alias("support_1"),
        F.when(known, F.coalesce("_s2", zero)).otherwise(zero).alias("support_2"),
        F.when(known & (one == two), F.coalesce("_s1", zero))
        .when(known, F.coalesce("frequency", zero))
        .otherwise(zero)
        .alias("frequency"),
        F.col("_n").alias("basket_count"),
        F.concat_ws(", ", F.when(one.isNull(), F.col("product_1")), F.when(two.isNull(), F.col("product_2"))).alias("missing"),
    )
    none = F.lit(0.0)
    confidence = F.coalesce(py_round(F.try_divide("frequency", "support_1") * 100, 1), none)
    reverse = F.coalesce(py_round(F.try_divide("frequency", "support_2") * 100, 1), none)
    expected = F.col("support_1").cast("double") * F.col("support_2") / F.nullif("basket_count", F.lit(0))
    lift = F.coalesce(py_round(F.try_divide(F.col("frequency"), expected), 2), none)
    measured = (
        counted.withColumn("confidence", confidence)
        .withColumn("confidence_reverse", reverse)
        .withColumn("lift", lift)
    )
    best = F.greatest("confidence", "confidence_reverse")
    score = py_round(association_score(best, F.col("lift"), F.col("frequency")), 2)
    tier = (
        F.when(F.col("missing") != "", "unknown")
        .when(F.col("score") >= STRONG_SCORE, "strong")
        .when(F.col("score") >= OFTEN_SCORE, "often")
        .when(F.col("score") >= MODERATE_SCORE, "moderate")
        .when((F.col("lift") >= 1) & (F.col("frequency") > 0), "weak")
        .otherwise("none")
    )
    return (
        measured.withColumn("score", score)
        .withColumn("tier", tier)
        .withColumn("together", F.col("tier").isin("strong", "often"))
    )


def related_products(
    metrics: DataFrame, product: str | None = None, n: int = 5, min_confidence: float = 5
) -> DataFrame:
    """The n best neighbours of each product (or of one) by rounded lift.

    Neighbours under `min_confidence` are listed only for a product none of whose neighbours
    reaches it. Putting passing neighbours first lets the ranking be trimmed to n rows per product
    before it is known which case applies.
    """
    columns = ["frequency", "lift"]
    forward = metrics.select(
        F.col("x").alias("product"), F.col("y").alias("neighbour"), F.col("support_x").alias("support"), *columns
    )
    backward = metrics.select(
        F.col("y").alias("product"), F.col("x").alias("neighbour"), F.col("support_y").alias("support"), *columns
    )
    both = forward.unionByName(backward)
    if product is not None:
        both = both.where(F.col("product") == product)
    rated = both.select(
        "product", "neighbour", "frequency", "support",
        py_round(F.col("frequency") / F.col("support") * 100, 1).alias("confidence"),
        py_round(F.col("lift"), 2).alias("lift"),
    ).withColumn("_pass", (F.col("confidence") >= min_confidence).cast("int"))
    top = ranked_within(rated, ["product"], [F.desc("_pass"), F.desc("lift"), F.col("neighbour")], n)
    any_pass = F.max("_pass").over(W.partitionBy("product"))
    return top.withColumn("_any", any_pass).where("_pass = _any").drop("_pass", "_any")
