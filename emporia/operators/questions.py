"""Business questions as a batch: what each asks for, and the answers.

A question table has (conv_id, turn, text); `turn` orders a conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emporia.functions.text import contained_names, quoted_names
from emporia.operators.basket import analyze_pairs, item_rows, pair_counts
from emporia.operators.topk import ranked_within, region_top_products
from emporia.schema import BASKET_KEYS
from emporia.sources.store import work_table

# The keywords that tell what a question asks for, matched anywhere in its
# lower-case text, and the number of results without a "top N".
COMPARISON_WORDS = [
    "compar", "différence", "et a", "c est les memes", "même chose", "entre", "vs", "versus",
]
FOLLOW_UP_WORDS = ["c est les memes", "même chose", "et a"]
SINGLE_WORDS = [
    "le produit le plus acheté", "le plus vendu", "le meilleur produit", "quel est le produit",
    "quel produit", "top 1", "un seul",
]
TOP_WORDS = ["top", "produit", "produits", "plus acheté", "meilleur", "best", "vendu"]
BASKET_WORDS = [
    "achetés ensemble", "co-occurrence", "souvent ensemble", "ensemble", "avec", "pair", "paire",
    "panier", "achete ensemble", "association", "combinaison",
]
CATEGORY_WORDS = ["catégorie", "type de produit", "famille", "categories"]
INSIGHT_WORDS = ["insight", "analyse globale", "résumé", "dashboard"]
DEFAULT_TOP, FOLLOW_UP_TOP = 5, 3

# What came of a question.
FOUND, NO_PRODUCT, NO_PAIR, TWO_NAMES = "found", "no product", "no pair", "two products needed"

KEYS = ["conv_id", "turn"]
ALL = ""  # a slice without restriction


def mentions(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def extract_filters(questions: DataFrame, categories: DataFrame, delegations: DataFrame) -> DataFrame:
    """Add what a question names: comparison and single-product flags, `top_n`, the first category
    and all delegations in it (the last one is the filter), and quoted product names."""
    low = F.lower("text")
    number = F.regexp_extract("text_low", r"top (\d+)", 1)
    single = mentions(F.col("text_low"), SINGLE_WORDS)
    top_n = F.when(number != "", F.coalesce(number.try_cast("bigint"), F.lit(2**63 - 1))).otherwise(
        F.when(single, 1).otherwise(DEFAULT_TOP)
    )
    flagged = (
        questions.select(*KEYS, "text")
        .withColumn("text_low", low)
        .withColumn("is_comparison", mentions(F.col("text_low"), COMPARISON_WORDS))
        .withColumn("top_n", top_n.cast("bigint"))
        .withColumn("single_product", single | ((number != "") & (F.col("top_n") == 1)))
        .withColumn("products", quoted_names(F.col("text")))
    )
    lists = {"_categories": (categories, "category"), "regions": (delegations, "delegation")}
    named = contained_names(work_table(flagged), "text", lists)
    return (
        named.withColumn("category", F.try_element_at("_categories", F.lit(1)))
        .withColumn("delegation", F.try_element_at("regions", F.lit(-1)))
        .drop("_categories")
    )


def carry_last(
    df: DataFrame, group: str, order: str, value: str, into: str, chunk: int = 10_000
) -> DataFrame:
    """Add the last non-null `value` on an earlier row of the group.

    Groups are cut into stretches of `chunk` order numbers: each stretch is scanned on its own and
    takes over what the stretches before it ended with, so a very long group is many tasks.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    before = (W.unboundedPreceding, -1)
    inside = F.last(value, ignorenulls=True).over(
        W.partitionBy(group, "_chunk").orderBy(order).rowsBetween(*before)
    )
    ends = cut.groupBy(group, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end")
    )
    inherited = ends.select(
        group,
        "_chunk",
        F.last("_end", ignorenulls=True)
        .over(W.partitionBy(group).orderBy("_chunk").rowsBetween(*before))
        .alias("_inherited"),
    )
    return (
        cut.withColumn("_inside", inside)
        .join(inherited, [group, "_chunk"], "left")
        .withColumn(into, F.coalesce("_inside", "_inherited"))
        .drop("_chunk", "_inside", "_inherited")
    )


def route_questions(filtered: DataFrame, slices: DataFrame) -> DataFrame:
    """Add `intent`, and `previous_region` for follow-up comparisons.

    `filtered` comes from `extract_filters`; `slices` has the (category, delegation) pairs that
    occur. The region a follow-up refers to is that of the last earlier question of the same
    conversation answered with a region's top products. Such an answer is possible only while a
    question is not itself a follow-up to an earlier one, so the first pass finds, without any
    context, which questions could set it, and the second pass applies it.
    """
    low, n_regions = F.col("text_low"), F.size("regions")
    follow_up = mentions(low, FOLLOW_UP_WORDS)
    two_regions = ~follow_up & (n_regions >= 2)
    without_context = (
        F.when(F.col("is_comparison") & two_regions, "comparison")
        .when(mentions(low, BASKET_WORDS), "basket")
        .when(mentions(low, TOP_WORDS), "top_products")
        .when(mentions(low, CATEGORY_WORDS), "categories")
        .when(two_regions, "comparison")
        .when(F.col("category").isNotNull() | (n_regions > 0), "top_products")
        .when(mentions(low, INSIGHT_WORDS), "insights")
        .otherwise("general")
    )
    occurring = slices.select("category", "delegation").distinct().withColumn("_occurs", F.lit(True))
    base = filtered.withColumn("_base", without_context).join(occurring, ["category", "delegation"], "left")
    answered = (
        (F.col("_base") == "top_products") & (F.col("top_n") > 0) & (F.col("category").isNull() | F.col("_occurs"))
    )
    asks_back = follow_up & (n_regions == 1)
    could_set = base.withColumn("_could", F.when(answered, F.col("delegation")))
    with_first = carry_last(could_set, "conv_id", "turn", "_could", "_context")
    is_follow_up = asks_back & F.col("_context").isNotNull()
    decided = with_first.withColumn("_follows", is_follow_up).withColumn(
        "_sets", F.when(~F.col("_follows"), F.col("_could"))
    )
    with_region = carry_last(decided, "conv_id", "turn", "_sets", "_region")
    return (
        with_region.withColumn("intent", F.when(F.col("_follows"), "comparison").otherwise(F.col("_base")))
        .withColumn("previous_region", F.when(F.col("_follows"), F.col("_region")))
        .drop("_base", "_occurs", "_could", "_context", "_follows", "_sets", "_region")
    )


def answer_top_products(routed: DataFrame, fact: DataFrame) -> DataFrame:
    """(conv_id, turn, rank, product_name, row_count, status): each question's top n in its slice.

    A question about a single product gets one at most. A question without any gets a row whose
    status is `NO_PRODUCT`; the status of products is `FOUND`.

    Counts per category, delegation and product are rolled up to every slice once, ranked once,
    and trimmed to the largest n asked for before questions look them up.
    """
    asked = routed.where("intent = 'top_products'").select(
        *KEYS,
        F.coalesce("category", F.lit(ALL)).alias("in_category"),
        F.coalesce("delegation", F.lit(ALL)).alias("in_delegation"),
        F.when(F.col("single_product"), F.least("top_n", F.lit(1))).otherwise(F.col("top_n")).alias("top_n"),
    )
    largest = asked.agg(F.max("top_n")).first()[0] or 0
    places = ["category", "delegation"]
    counts = (
        fact.where("product_name IS NOT NULL")
        .groupBy(*places, "product_name")
        .agg(F.count("*").alias("c"))
        .groupingSets(
            [[*places, "product_name"], ["category", "product_name"], ["delegation", "product_name"], ["product_name"]],
            *places, "product_name",
        )
        .agg(F.sum("c").alias("row_count"), F.grouping("category").alias("_gc"), F.grouping("delegation").alias("_gd"))
        .where("(_gc = 1 OR category IS NOT NULL) AND (_gd = 1 OR delegation IS NOT NULL)")
        .select(
            F.when(F.col("_gc") == 1, ALL).otherwise(F.col("category")).alias("in_category"),
            F.when(F.col("_gd") == 1, ALL).otherwise(F.col("delegation")).alias("in_delegation"),
            "product_name",
            "row_count",
        )
    )
    order = [F.desc("row_count"), F.col("product_name")]
    ranked = work_table(ranked_within(counts, ["in_category", "in_delegation"], order, largest))
    listed = (
        asked.join(ranked, ["in_category", "in_delegation"])
        .where(F.col("rank") <= F.col("top_n"))
        .select(*KEYS, "rank", "product_name", "row_count")
    )
    return with_status(asked, listed, FOUND, NO_PRODUCT)


def with_status(asked: DataFrame, listed: DataFrame, found: str, none: str) -> DataFrame:
    """The listed answers, and a row for every question without one."""
    rows = listed.withColumn("_found", F.lit(found))
    return asked.select(*KEYS).join(rows, KEYS, "left").withColumn("status", F.coalesce("_found", F.lit(none))).drop("_found")


def sliced_baskets(fact: DataFrame, slices: DataFrame) -> DataFrame:
    """Stored (in_category, in_delegation, items, size): what every basket of two items or more holds in each asked slice.

    A basket's purchases meet once, whatever the slices; those of its slices that were asked for are cut out
    of it in place.
    """
    by = ["in_category", "in_delegation"]
    rows = item_rows(fact, by=["category", "delegation"])
    whole = rows.groupBy(*BASKET_KEYS).agg(F.collect_set(F.struct("category", "delegation", "item")).alias("held"))

    def place(category: Column, delegation: Column) -> Column:
        return F.struct(category.alias("in_category"), delegation.alias("in_delegation"))

    def values(column: str) -> Column:
        return F.array_remove(F.array_distinct(F.transform("held", lambda row: row[column])), ALL)

    all_ = F.lit(ALL)
    both = F.array_distinct(F.transform("held", lambda row: place(row["category"], row["delegation"])))
    places = F.concat(
        F.array(place(all_, all_)),
        F.transform(values("category"), lambda c: place(c, all_)),
        F.transform(values("delegation"), lambda d: place(all_, d)),
        F.filter(both, lambda p: (p["in_category"] != ALL) & (p["in_delegation"] != ALL)),
    )

    def inside(row: Column, p: Column) -> Column:
        return reduce(lambda a, b: a & b, [(p[f"in_{c}"] == ALL) | (row[c] == p[f"in_{c}"]) for c in ("category", "delegation")])

    def basket(p: Column) -> Column:
        rows = F.filter("held", lambda row: inside(row, p))
        return F.struct(p["in_category"], p["in_delegation"], F.sort_array(F.array_distinct(F.transform(rows, lambda row: row["item"]))).alias("items"))

    cut = whole.select(F.inline(F.filter(F.transform(places, basket), lambda b: F.size(b["items"]) >= 2)))
    asked = work_table(slices.select(*by).distinct())
    return work_table(cut.join(asked, by, "left_semi").select(*by, "items", F.size("items").alias("size")))


def sliced_pairs(fact: DataFrame, slices: DataFrame, n: int) -> DataFrame:
    """The n most frequent pairs of each asked (in_category, in_delegation) slice."""
    by = ["in_category", "in_delegation"]
    pairs = pair_counts(sliced_baskets(fact, slices), by=by)
    return ranked_within(pairs, by, [F.desc("frequency"), F.col("x"), F.col("y")], n)


def answer_pairs(routed: DataFrame, fact: DataFrame) -> DataFrame:
    """Answers to basket questions: the association of the first two quoted names, or else the
    most frequent pairs of the question's slice.

    (conv_id, turn, rank, product_1, product_2, frequency, confidence, tier, status); confidence and
    tier are null for frequent pairs. Every question has a row: without pairs its status is
    `NO_PAIR`, with a blank name among the first two `TWO_NAMES`.
    """
    asked = routed.where("intent = 'basket'").select(
        *KEYS, "products", "top_n",
        F.coalesce("category", F.lit(ALL)).alias("in_category"),
        F.coalesce("delegation", F.lit(ALL)).alias("in_delegation"),
    )
    named = asked.where(F.size("products") >= 2).select(
        *KEYS,
        F.trim(F.col("products")[0]).alias("product_1"),
        F.trim(F.col("products")[1]).alias("product_2"),
    ).where("product_1 <> '' AND product_2 <> ''")
    analyzed = work_table(
        analyze_pairs(fact, named).select(
            "product_1", "product_2", "matched_1", "matched_2", "frequency", "confidence", "tier"
        )
    )
    blank = with_status(
        asked.where(F.size("products") >= 2).join(named, KEYS, "left_anti"), named.limit(0).select(*KEYS), FOUND, TWO_NAMES
    )
    about_names = named.join(analyzed, ["product_1", "product_2"]).select(
        *KEYS, F.lit(1).alias("rank"),
        F.coalesce("matched_1", "product_1").alias("product_1"),
        F.coalesce("matched_2", "product_2").alias("product_2"),
        "frequency", "confidence", "tier", F.lit(FOUND).alias("status"),
    )
    open_questions = asked.where(F.size("products") < 2)
    largest = open_questions.agg(F.max("top_n")).first()[0] or 0
    ranked = work_table(sliced_pairs(fact, open_questions, largest))
    about_slices = (
        open_questions.join(ranked, ["in_category", "in_delegation"])
        .where(F.col("rank") <= F.col("top_n"))
        .select(
            *KEYS, "rank", F.col("x").alias("product_1"), F.col("y").alias("product_2"), "frequency",
            F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("tier"),
        )
    )
    answered = with_status(open_questions, about_slices, FOUND, NO_PAIR)
    return about_names.unionByName(answered).unionByName(blank, allowMissingColumns=True)


def answer_comparisons(routed: DataFrame, fact: DataFrame) -> DataFrame:
    """(conv_id, turn, side, region, rank, product_name, row_count, common) of comparisons.

    The first two regions named with five products each, or for a follow-up the previous region
    and the named one with three; `common` marks products listed for both.
    """
    follow_up = F.col("previous_region").isNotNull()
    pairs = F.when(follow_up, F.array("previous_region", F.try_element_at("regions", F.lit(1)))).otherwise(
        F.slice("regions", 1, 2)
    )
    asked = (
        routed.where("intent = 'comparison'")
        .withColumn("n", F.when(follow_up, FOLLOW_UP_TOP).otherwise(DEFAULT_TOP))
        .select(*KEYS, "n", F.posexplode(pairs).alias("side", "delegation"))
    )
    top = work_table(region_top_products(fact, DEFAULT_TOP))
    listed = asked.join(top, "delegation").where(F.col("rank") <= F.col("n"))
    sides = F.size(F.collect_set("side").over(W.partitionBy(*KEYS, "product_name")))
    return listed.withColumn("common", sides == 2).select(
        *KEYS, (F.col("side") + 1).alias("side"), F.col("delegation").alias("region"), "rank",
        "product_name", "row_count", "common",
    )
