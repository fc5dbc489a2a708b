"""How filters interact: what each removes after the others, in every order."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporia.llm import term_matrix
from emporia.sources.store import work_table

FILTERS = "ABCDE"
LEAST_WORDS = 200  # A
LEAST_DISTINCT = 50  # B, percent of the words


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails): bits of the filters A to E that each row of `docs` fails.

    Null texts are empty, null sources the part ''. A row fails E if a smaller doc_id has the same text (told
    by SHA-256); a null doc_id is neither smaller nor larger than any. Repeated rows each count.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # A row sum of the matrix is the number of words, a nonzero count that of distinct ones.
    stats = work_table(term_matrix.build(rows).row_statistics())
    # Copies fold before the shuffle; only digests that several ids have are joined with the rows.
    firsts = stats.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = firsts.where("last > first").select("digest", "first")
    short = F.col("n_words") < LEAST_WORDS
    dull = 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    fails = (
        short.cast("int") * bit("A")
        + dull.cast("int") * bit("B")
        + F.col("marks")  # C and D
        + again.cast("int") * bit("E")
    )
    return stats.join(copies, "digest", "left").select("doc_id", "part", fails.alias("fails"))


def tallies(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): rows by the set of filters they fail.

    Of several labels of one doc_id the highest counts; null ones do not.
    """
    known = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
    )
    rows = flagged(docs).join(known, "doc_id", "left")
    return rows.groupBy("part", "fails").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("good"), 1)).alias("good"),
        F.count(F.when(F.col("toxic"), 1)).alias("toxic"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, order of the filters and step, with counts of documents and `shapley`.

    All sums come from at most 32 tallies a part. `shapley` is what the step's filter removes, summed
    over all orders. An empty table has no parts, so no rows.
    """
    sums = work_table(tallies(docs, labels))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    rows = parts.select("part", "sets", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])).alias("step"))

    def bits(letters):
        return sum(((F.instr(letters, x) > 0).cast("int") * bit(x) for x in FILTERS), F.lit(0))

    rows = rows.select(
        "*", bits(F.expr("left(filter_order, step - 1)")).alias("before"), bits(F.expr("substr(filter_order, step, 1)")).alias("own")
    )

    def total(value: str, condition) -> F.Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda s, x: s + F.when(condition(x.fails), x[value]).otherwise(0))

    before, own = F.col("before"), F.col("own")
    removed = lambda f: (f.bitwiseAND(before) == 0) & (f.bitwiseAND(own) != 0)
    counted = rows.select(
        "part", "filter_order", "step", "own",
        total("n", lambda f: f.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda f: (f.bitwiseAND(before) != 0) & (f.bitwiseAND(own) != 0)).alias("redundant"),
        total("n", lambda f: f == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
