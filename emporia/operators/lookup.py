"""Value lists, filters and name matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporia.functions.text import contains_join, plain_words
from emporia.sources.store import work_table

# Texts and names of at most this many distinct words are matched through word subsets.
SUBSET_WORDS = 8


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def list_categories(fact: DataFrame) -> DataFrame:
    column = "category" if "category" in fact.columns else "product_id"
    return distinct_values(fact, column).orderBy(column)


def list_delegations(fact: DataFrame) -> DataFrame:
    return distinct_values(fact, "delegation").orderBy("delegation")


def list_localities(fact: DataFrame, delegation: str | None = None) -> DataFrame:
    return distinct_values(filter_slice(fact, delegation=delegation), "locality").orderBy("locality")


def location_dims(fact: DataFrame) -> DataFrame:
    """Regions and categories of rows having both keys and a price, as (kind, value)."""
    usable = fact.dropna(subset=["category", "delegation", "total_price"])
    pairs = usable.select("category", "delegation").distinct()
    kinds = F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("region").alias("kind"), F.col("delegation").alias("value")),
    )
    return pairs.select(F.inline(kinds)).distinct()


def search_products(fact: DataFrame, query: str = "", n: int = 20) -> DataFrame:
    names = fact.where(contains_text("product_name", query)) if query else fact
    return distinct_values(names, "product_name").orderBy("product_name").limit(n)


def contains_text(column: str, text: str) -> Column:
    """Case-insensitive literal substring."""
    return F.lower(F.col(column)).contains(text.lower())


def filter_slice(df: DataFrame, category: str | None = None, delegation: str | None = None) -> DataFrame:
    for column, value in (("category", category), ("delegation", delegation)):
        if value:
            df = df.where(F.col(column) == value)
    return df


def filter_product(df: DataFrame, name: str, exact: bool = False) -> DataFrame:
    if exact:
        return df.where(F.lower("product_name") == name.lower())
    return df.where(contains_text("product_name", name))


def customer_history(fact: DataFrame, client_id: str) -> DataFrame:
    """All purchases of one client; not-a-number becomes null."""
    doubles = {c: F.nanvl(F.col(c), F.lit(None)) for c, t in fact.dtypes if t == "double"}
    return fact.where(F.col("client_id") == client_id).withColumns(doubles)


def word_subsets(words: Column) -> Column:
    """All non-empty subsets of a short sorted word list, each as one text."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size(words)) - 1).cast("int"))

    def member(mask: Column):
        return lambda word, at: F.call_function("shiftright", mask, at).bitwiseAND(F.lit(1)) == 1

    return F.transform(masks, lambda mask: F.array_join(F.filter(words, member(mask)), " "))


def best_shared_words(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(_q, _shared_name): the name sharing most words with each distinct text `_q`, if any.

    A word repeated in the text counts each time. Texts and names of few words meet through their
    word subsets: the index keeps one name per subset, so a word in very many names costs a text
    one row. Longer ones, which are rare, meet name by name on their words.
    """
    asked = texts.withColumn("_all", plain_words(F.col("_q"))).withColumn(
        "_words", F.array_sort(F.array_distinct("_all"))
    )
    folded = (
        names.groupBy(F.array_sort(F.array_distinct(plain_words(F.col("_low")))).alias("_words"))
        .agg(F.min("product_name").alias("_name"))
        .where(F.size("_words") > 0)
    )
    few = F.size("_words") <= SUBSET_WORDS

    index = (
        folded.where(few)
        .select("_name", F.explode(word_subsets(F.col("_words"))).alias("_subset"))
        .groupBy("_subset")
        .agg(F.min("_name").alias("_name"))
    )
    by_subset = (
        asked.where(few & (F.size("_words") > 0))
        .select("_q", "_all", F.explode(word_subsets(F.col("_words"))).alias("_subset"))
        .join(index, "_subset")
        .withColumn("_members", F.split("_subset", " "))
        .select(
            "_q", "_name",
            F.size(F.filter("_all", lambda w: F.array_contains("_members", w))).cast("bigint").alias("_shared"),
        )
    )

    def word_by_word(left: DataFrame, right: DataFrame) -> DataFrame:
        left_words = left.select("_q", F.explode("_all").alias("_word")).groupBy("_q", "_word")
        return (
            left_words.agg(F.count("*").alias("_times"))
            .join(right.select("_name", F.explode("_words").alias("_word")), "_word")
            .groupBy("_q", "_name")
            .agg(F.sum("_times").alias("_shared"))
        )

    return (
        by_subset.unionByName(word_by_word(asked.where(~few), folded))
        .unionByName(word_by_word(asked.where(few), folded.where(~few)))
        .groupBy("_q")
        .agg(F.min(F.struct(-F.col("_shared"), F.col("_name").alias("name"))).alias("_best"))
        .select("_q", F.col("_best.name").alias("_shared_name"))
    )


def match_product_name(queries: DataFrame, products: DataFrame, query: str = "query") -> DataFrame:
    """(query, matched): each distinct text with its product name, null when there is none.

    Rules in order: equal ignoring case; the name starts with the text; most shared words; the
    name contains the text, if that has four letters or more. Ties go to the first name by code
    point. A blank text has no match.

    No rule compares all texts with all names: the first two look up an index of name beginnings
    that keeps one name per beginning, the third an index of word subsets, the fourth joins on
    pieces of the names.
    """
    asked = queries.select(query).distinct().withColumn("_q", F.lower(F.trim(query)))
    names = work_table(
        distinct_values(products, "product_name").withColumn("_low", F.lower("product_name"))
    )

    starts = (
        names.withColumn("_size", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_low"), F.lit(1)))))
        .groupBy(F.substring(F.col("_low"), F.lit(1), F.col("_size")).alias("_q"))
        .agg(
            F.min(F.when(F.col("_size") == F.length("_low"), F.col("product_name"))).alias("_exact"),
            F.min("product_name").alias("_prefix"),
        )
        .where("_q <> ''")
    )
    by_start = asked.join(starts, "_q", "left")
    first = work_table(by_start.select(query, "_q", F.coalesce("_exact", "_prefix").alias("_start")))
    open_texts = first.where("_start IS NULL AND _q <> ''").select("_q").distinct()

    by_words = work_table(best_shared_words(open_texts, names))
    still_open = work_table(open_texts.join(by_words, "_q", "left_anti").where(F.length("_q") >= 4))
    by_part = (
        contains_join(names, "_low", still_open, "_q")
        .groupBy("_q")
        .agg(F.min("product_name").alias("_part"))
    )
    return (
        first.join(by_words, "_q", "left")
        .join(by_part, "_q", "left")
        .select(query, F.coalesce("_start", "_shared_name", "_part").alias("matched"))
    )


def resolve_category(queries: DataFrame, categories: DataFrame, query: str = "query") -> DataFrame:
    """(query, category): equal, equal ignoring case, containing or contained (first in order);
    an unknown text stays as it is and a missing one becomes the first category."""
    known = work_table(distinct_values(categories, "category").withColumn("_low", F.lower("category")))
    asked = work_table(queries.select(query).distinct().withColumn("_q", F.lower(query)))
    exact = known.select(F.col("category").alias(query), F.col("category").alias("_exact"))
    ignoring_case = known.groupBy(F.col("_low").alias("_q")).agg(F.max("category").alias("_same"))
    texts = asked.select("_q").where("_q <> ''").distinct()
    overlapping = (
        contains_join(known, "_low", texts, "_q")
        .select("_q", "category")
        .unionByName(contains_join(texts, "_q", known, "_low").select("_q", "category"))
        .groupBy("_q")
        .agg(F.min("category").alias("_overlap"))
    )
    first = known.agg(F.min("category")).scalar()
    found = (
        asked.join(exact, query, "left").join(ignoring_case, "_q", "left").join(overlapping, "_q", "left")
    )
    empty = F.col(query).isNull() | (F.col(query) == "")
    return found.select(
        query,
        F.when(empty, F.coalesce(first, F.lit("")))
        .otherwise(F.coalesce("_exact", "_same", "_overlap", query))
        .alias("category"),
    )
