"""Text helpers and substring joins without a cross join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporia.sources.store import work_table

GRAM = 4
STRETCH = 256  # least characters of a text whose places are looked at together
WINDOW = 64  # characters that a place of a text carries, at most


def plain_words(text: Column) -> Column:
    """Word tokens; the flag makes accented letters part of words."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))


def quoted_names(text: Column) -> Column:
    """Contents of double- or single-quoted spans, in order."""
    spans = F.regexp_extract_all(text, F.lit("\"([^\"]+)\"|'([^']+)'"), F.lit(0))
    return F.transform(spans, lambda s: F.substring(s, F.lit(2), F.length(s) - 2))


def stretches_of(whole: DataFrame, step: int, overlap: int) -> DataFrame:
    """(_id, _at, _part): texts cut every `step` characters, each part with `overlap` more."""
    starts = F.sequence(F.lit(1), F.length("_whole"), F.lit(step))
    parts = F.transform(starts, lambda s: F.substring(F.col("_whole"), s, F.lit(step + overlap)))
    return whole.select("_id", F.posexplode(parts).alias("_at", "_part"))


def places_of(step: int) -> Column:
    """The places of a part that belong to it."""
    return F.sequence(F.lit(1), F.least(F.length("_part"), F.lit(step)))


def short_pieces(whole: DataFrame, index: DataFrame, sizes: list[int], longest: int) -> DataFrame:
    """(_id, _hash) of every piece of a text that is as long as a needle of the same beginning."""
    windows = F.transform(places_of(STRETCH), lambda i: F.substring(F.col("_part"), i, F.lit(longest)))
    piece = F.substring(F.col("_window"), F.lit(1), F.col("_length"))
    return (
        stretches_of(whole, STRETCH, longest)
        .select("_id", F.explode(windows).alias("_window"))
        .withColumn("_size", F.explode(F.array(*[F.lit(n) for n in sizes])))
        .withColumn("_key", F.substring(F.col("_window"), F.lit(1), F.col("_size")))
        .where(F.length("_key") == F.col("_size"))
        .join(index, "_key")
        .withColumn("_length", F.explode("_lengths"))
        .where((F.col("_length") <= longest) & (F.length("_window") >= F.col("_length")))
        .select("_id", F.xxhash64(piece).alias("_hash"))
    )


def long_pieces(whole: DataFrame, needles: DataFrame, needle: str, longest: int) -> DataFrame:
    """The same for needles of more than WINDOW characters.

    A place carries only a hash of its first WINDOW characters; where a needle begins alike, the place goes back
    to its stretch, which hashes one piece per length. Stretches are at least as long as the longest needle,
    so they store a text at most twice.
    """
    step = max(longest, STRETCH)
    stretches = work_table(stretches_of(whole, step, longest))
    heads = work_table(
        needles.where(F.length(needle) > WINDOW)
        .groupBy(F.xxhash64(F.substring(needle, 1, WINDOW)).alias("_head"))
        .agg(F.collect_set(F.length(needle)).alias("_lengths"))
    )
    head = F.transform(
        places_of(step),
        lambda i: F.struct(i.alias("_place"), F.xxhash64(F.substring(F.col("_part"), i, F.lit(WINDOW))).alias("_head")),
    )
    places = (
        stretches.select("_id", "_at", F.inline(head))
        .join(heads, "_head")
        .groupBy("_id", "_at")
        .agg(F.collect_list(F.struct("_place", "_lengths")).alias("_places"))
    )

    def hashes(place: Column) -> Column:
        left = F.length("_part") - place["_place"] + 1
        fits = F.filter(place["_lengths"], lambda n: n <= left)
        return F.transform(fits, lambda n: F.xxhash64(F.substring(F.col("_part"), place["_place"], n)))

    return stretches.join(places, ["_id", "_at"]).select(
        "_id", F.explode(F.flatten(F.transform("_places", hashes))).alias("_hash")
    )


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Every (text row, needle row) where the text contains the needle, by equality joins.

    Needles, which must be distinct, are indexed by their first four characters (all of them when
    shorter) with the lengths that occur. Texts are cut into stretches, and each place of a stretch gives a
    window as long as the longest needle, but no longer than WINDOW: what is moved grows with the text, whatever
    the needles. A window whose first characters are in the index gives a hash per length, and these are looked
    up among the needles' hashes; longer needles are found through `long_pieces`. So only true matches are
    ever paired, also when very many needles or texts share a beginning. Empty needles match nothing.
    """
    keyed = needles.where(F.length(needle) > 0).select(
        F.substring(needle, 1, GRAM).alias("_key"), F.length(needle).alias("_length")
    )
    index = work_table(keyed.groupBy("_key").agg(F.collect_set("_length").alias("_lengths")))
    # At most four sizes and one number.
    sizes, longest = index.agg(F.collect_set(F.length("_key")), F.max(F.array_max("_lengths"))).first()
    if not sizes:
        return texts.limit(0).join(needles.limit(0), F.contains(F.col(text), F.col(needle)))
    whole = texts.where(F.length(text) > 0).select(F.xxhash64(text).alias("_id"), F.col(text).alias("_whole")).distinct()
    pieces = short_pieces(whole, index, sorted(sizes), min(longest, WINDOW))
    if longest > WINDOW:
        pieces = pieces.unionByName(long_pieces(whole, needles, needle, longest))
    found = pieces.distinct().join(needles.withColumn("_hash", F.xxhash64(needle)), "_hash").drop("_hash")
    held = F.contains(F.col(text), F.col(needle))  # for texts or needles that share a hash
    return texts.withColumn("_id", F.xxhash64(text)).join(found, "_id").where(held).drop("_id")


def contained_names(texts: DataFrame, text: str, names: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Add a column per entry of `names`, a table and its column of names: the sorted names whose lower-case
    form occurs in the lower-case `text`.

    Distinct texts meet the distinct names of all entries in one `contains_join`; an empty name is
    contained in nothing.
    """
    listed = [
        table.select(F.lit(into).alias("_into"), F.col(column).alias("_name")).where("_name IS NOT NULL").distinct()
        for into, (table, column) in names.items()
    ]
    lows = (
        reduce(DataFrame.unionByName, listed)
        .groupBy(F.lower("_name").alias("_low"))
        .agg(*[F.collect_set(F.when(F.col("_into") == into, F.col("_name"))).alias(f"_in_{into}") for into in names])
    )
    lowered = texts.select(F.lower(F.col(text)).alias("_text")).where("_text IS NOT NULL").distinct()
    found = (
        contains_join(lowered, "_text", work_table(lows), "_low")
        .groupBy("_text")
        .agg(*[F.array_sort(F.flatten(F.collect_list(f"_in_{into}"))).alias(into) for into in names])
    )
    empty = F.array().cast("array<string>")
    return (
        texts.join(found, F.lower(F.col(text)) == F.col("_text"), "left")
        .withColumns({into: F.coalesce(into, empty) for into in names})
        .drop("_text")
    )
