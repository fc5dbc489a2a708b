"""Mixing sources to target weights: Sainte-Laguë quotas of equal blocks of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporia.llm.common import buckets_for, fresh, keeps_own_columns, running_total, word_count
from emporia.sources.store import work_table

SHARDS = 8
REPEATS = 3  # no document and no source is taken more often than this
WEIGHTS = (1, 2, 3)  # of the sources in code point order, repeating
BLOCKS = 100  # blocks that the smallest target is worth, at least
SEED = 20
ADDED = ("size", "source_size", "target", "taken")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, target) for every source of `sized` (source, size).

    The targets share the sum of all sizes by weight; none is above `repeats` times its source, and
    what is cut off goes to the others by weight. In order of the ratio of cap to weight, a
    source is capped as long as its ratio is below the level that the uncapped ones would share.
    One row per source is ranked here, whatever the number of documents.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.lit(list(weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        by_source.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    everything = Window.partitionBy()
    earlier = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    )
    levels = ranked.withColumn("level", level).withColumn("free", F.col("ratio") > F.col("level"))
    shared = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct("ratio", "rank")))
    return levels.withColumn("shared", shared.over(everything)).select(
        "source",
        "rank",
        "source_size",
        F.when(F.col("ratio") > F.col("shared"), F.col("weight") * F.col("shared"))
        .otherwise(F.col("cap"))
        .cast("double")
        .alias("target"),
    )


def apportion(claims: DataFrame) -> DataFrame:
    """(house, rank, seats) by Sainte-Laguë for `claims` (house, seats_in_house, rank, target).

    Rounding every share gives nearly all seats; the few that are missing, or too many, are settled by
    the highest (lowest) quotients target / (2 k + 1) next to it. Ties go to the smaller rank.
    """
    house = Window.partitionBy("house")
    total = F.sum("target").over(house)
    first = claims.withColumn(
        "base",
        F.when(total > 0, F.floor(F.col("target") / total * F.col("seats_in_house") + 0.5)).otherwise(0),
    )
    short = F.when(total > 0, F.col("seats_in_house") - F.sum("base").over(house)).otherwise(0)
    slack = F.abs("short") + F.count("*").over(house)
    reach = F.ceil(slack * F.col("target") / total).cast("int") + 1
    open_ = first.withColumn("short", short).withColumn("reach", F.when(F.col("short") != 0, reach).otherwise(0))
    step = F.explode(F.sequence(F.lit(1), F.col("reach")))
    more = (
        open_.where("short > 0 AND target > 0")
        .withColumn("k", step)
        .withColumn("quotient", F.col("target") / (2 * (F.col("base") + F.col("k")) - 1))
        .withColumn("place", F.row_number().over(house.orderBy(F.desc("quotient"), "rank")))
        .where(F.col("place") <= F.col("short"))
        .select("house", "rank", F.lit(1).alias("change"))
    )
    less = (
        open_.where("short < 0 AND target > 0")
        .withColumn("k", step)
        .where(F.col("base") - F.col("k") >= 0)
        .withColumn("quotient", F.col("target") / (2 * (F.col("base") - F.col("k")) + 1))
        .withColumn("place", F.row_number().over(house.orderBy("quotient", F.desc("rank"))))
        .where(F.col("place") <= -F.col("short"))
        .select("house", "rank", F.lit(-1).alias("change"))
    )
    changes = more.unionByName(less).groupBy("house", "rank").agg(F.sum("change").alias("change"))
    return first.join(changes, ["house", "rank"], "left").select(
        "house", "rank", (F.col("base") + F.coalesce("change", F.lit(0))).cast("long").alias("seats")
    )


def shard_quotas(targets: DataFrame, seats: int, shards: int = SHARDS) -> DataFrame:
    """(shard, rank, drawn, quota): blocks of the source for the shard, and those drawn before it.

    Sainte-Laguë never takes a seat away when the house grows, so the quotas of a shard are the seats
    of the first shards up to it, less those without it: whole numbers, none negative, and every
    run of shards from the first on holds the mix.
    """
    ends = F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("house")
    claims = targets.select("rank", "target", ends).withColumn(
        "seats_in_house", F.floor(F.lit(seats) * F.col("house") / shards)
    )
    up_to = Window.partitionBy("rank").orderBy("house")
    return apportion(claims).select(
        (F.col("house") - 1).alias("shard"),
        "rank",
        F.coalesce(F.lag("seats").over(up_to), F.lit(0)).alias("drawn"),
        (F.col("seats") - F.coalesce(F.lag("seats").over(up_to), F.lit(0))).alias("quota"),
    )


def draws(targets: DataFrame, shards: int = SHARDS, seed: int = SEED, repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, target, shard, quota, first, words, start, given): what each shard draws.

    All sources are cut into blocks of the same number of words, at most 1 / `BLOCKS` of the smallest
    positive target; the highest quotients give every shard its whole quota of blocks of every source. The
    blocks of a source are dealt to the shards in stripes (words `first` to `first + words`), and a
    shard draws its quota from its own stripe: one block after the other from a seeded one on, around the
    stripe, `repeats` times at most. The words after the last whole block are a stripe without a shard
    (`shard` is the number of shards, `quota` 0).

    `given` is the number of words drawn. What a source's quotas lack of its target, or have beyond it,
    about a block or two, is settled in words: the stripes in turn go on drawing, or give back what they drew last.
    """
    total, least = targets.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.min(F.when(F.col("target") > 0, F.col("target")))
    ).first()
    block = max(1, int((least or 0) // BLOCKS))
    quotas = shard_quotas(targets, total // block, shards).select("shard", "rank", "quota")
    blocks = F.floor(F.col("source_size") / block)
    first = F.floor(blocks * F.col("shard") / shards)
    end = F.floor(blocks * (F.col("shard") + 1) / shards)
    is_tail = F.col("shard") == shards
    by_source = Window.partitionBy("rank")
    earlier = by_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    stripes = (
        targets.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards))))
        .join(quotas, ["rank", "shard"], "left")
        .withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))
        .withColumn("blocks", F.when(is_tail, F.lit(1)).otherwise(end - first).cast("long"))
        .withColumn("first", (first * block).cast("long"))
        .withColumn("words", F.when(is_tail, F.col("source_size") % block).otherwise((end - first) * block).cast("long"))
        .withColumn("drawn", F.least(F.col("quota") * block, F.col("words") * repeats))
        .withColumn("room", F.col("words") * repeats - F.col("drawn"))
        .withColumn("lack", F.round("target").cast("long") - F.sum("drawn").over(by_source))
    )
    more = F.least(F.col("room"), F.col("lack") - F.coalesce(F.sum("room").over(earlier), F.lit(0)))
    less = F.least(F.col("drawn"), -F.col("lack") - F.coalesce(F.sum("drawn").over(earlier), F.lit(0)))
    chosen = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.greatest("blocks", F.lit(1)))
    return stripes.withColumns(
        {
            "given": F.col("drawn") + F.greatest(more, F.lit(0)) - F.greatest(less, F.lit(0)),
            "start": F.col("first") + F.when(is_tail, F.lit(0)).otherwise(chosen * block),
        }
    ).select("source", "rank", "source_size", "target", "shard", "quota", "first", "words", "start", "given")


@keeps_own_columns
def mix(docs: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Rows of `docs` with size (words), source_size, target (of the source) and taken (words).

    A source's documents stand in a seeded order, and their words are cut into equal blocks, of which every
    shard draws its quota (see `draws`). `taken` counts the drawn words of a document, in all shards together.
    A document is cut only where a draw begins or ends, since a shard's blocks follow each other in that
    seeded order. Every source, however small, is within a word of its target. Sizes, targets and draws
    depend on the rows only: reruns agree.

    A null text has size 0; a null source is a source of its own, last in order. Repeated rows count
    one by one. Columns named like the added ones are replaced, all others keep their names and values,
    also those named like inner ones; an empty table gives an empty result.
    """
    return mix_sized(sized(fresh(docs, *ADDED), seed), shards, weights, seed)


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Add the size and the seeded order of a row."""
    order = F.xxhash64("doc_id", "text", F.lit(seed))
    return docs.withColumns({"size": word_count(F.col("text")), "_order": order})


def mix_sized(
    rows: DataFrame, shards: int = SHARDS, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED
) -> DataFrame:
    """`mix` for rows that have `size` and `_order`, whose text is no longer needed."""
    rows = work_table(rows)
    stripe = F.struct("shard", "first", "words", "start", "given")
    plan = (
        draws(work_table(source_targets(rows, weights)), shards, seed)
        .groupBy(F.col("source").alias("_source"), "source_size", "target")
        .agg(F.sort_array(F.collect_list(stripe)).alias("_stripes"))
    )
    placed = running_total(rows, "source", "_order", "size", "_begin", buckets_for(rows.count(), 2000))
    found = placed.join(work_table(plan), F.col("source").eqNullSafe(F.col("_source")))
    begin, end = F.col("_begin"), F.col("_begin") + F.col("size")

    def overlap(start, stop):
        return F.greatest(F.least(end, stop) - F.greatest(begin, start), F.lit(0))

    def drawn_from(s):
        """Words of the document among those given by the stripe: whole rounds, and an arc of the next."""
        first, after = s["first"], s["first"] + s["words"]
        rounds, beyond = F.floor(s["given"] / s["words"]), s["given"] % s["words"]
        stop = s["start"] + beyond
        arc = overlap(s["start"], F.least(stop, after)) + overlap(first, first + stop - after)
        return rounds * overlap(first, after) + arc

    touched = F.filter("_stripes", lambda s: (s["first"] < end) & (s["first"] + s["words"] > begin) & (s["words"] > 0))
    taken = F.aggregate(touched, F.lit(0).cast("long"), lambda n, s: n + drawn_from(s).cast("long"))
    return found.withColumn("taken", taken).drop("_source", "_stripes", "_begin", "_order")


@keeps_own_columns
def repeat_taken(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each as often as its taken words make it up, rounded; columns of `docs`."""
    own = {c: f"_own_{c}" for c in docs.columns if c.lower() in ADDED}
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    mixed = mix(docs.withColumnsRenamed(own), **options).withColumn("_copies", copies).where("_copies > 0")
    repeated = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
