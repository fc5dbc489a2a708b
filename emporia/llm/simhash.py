"""Near duplicates by SimHash fingerprints, joined on pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporia.llm.common import fresh, keeps_own_columns
from emporia.llm.graph import components
from emporia.sources.store import work_table

BITS = 64
SEED = 42
WIDTH = 3  # words in a shingle
DISTANCE = 2  # differing bits that still link
BLOCK = 1 << 16  # shingles whose bits are counted at once
SMALL_BUCKET = 32  # members of a block bucket that are paired one by one


def fingerprint_of(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint of one text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1]))
    ends = ends[width - 1 :] - 1 if len(words) >= width else ends[-1:] - 1
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        places = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in places], np.dtype("<u8"))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """64-bit SimHash as a signed long: a bit is set if over half of the shingles' XXH64 have it.

    Words are runs of non-space bytes with A-Z lower-cased; shingles count as often as they occur;
    a shorter text is one shingle, an empty or null one has fingerprint 0.
    """

    @F.pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                np.fromiter((fingerprint_of(t, width) for t in texts), np.uint64, len(texts)).view(np.int64)
            )

    return udf(text)


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def differing_bits(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of all choices of `blocks - distance` blocks: fingerprints that differ in at most
    `distance` bits agree on at least one of them."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect all those within `distance` bits.

    Fingerprints meet on pigeonhole blocks and are verified by their Hamming distance. Buckets of at
    most SMALL_BUCKET members are paired by a join. A larger bucket (near copies of one text by the
    thousand) is not: its members meet at the fingerprints that lie halfway, each being linked with one
    of those that share the halfway point. That is exact as well, links the same classes, and its
    rows grow in proportion to the members. `distance` 0 gives no edges.
    """
    if distance == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    masks = block_masks(distance, blocks or distance + 3)
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part"))
            for i, m in enumerate(masks)
        ]
    )
    met = prints.select("fp", F.explode(keys).alias("key")).select("fp", "key.mask", "key.part")
    sizes = met.groupBy("mask", "part").agg(F.count("*").alias("members")).where("members > 1")
    met = work_table(met.join(sizes, ["mask", "part"]))
    few = met.where(F.col("members") <= SMALL_BUCKET).drop("members")
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(few.withColumnRenamed("fp", "b"), ["mask", "part"])
        .where("a < b")
        .select("a", "b")
    )
    many = met.where(F.col("members") > SMALL_BUCKET).drop("members")
    near, far = distance // 2, distance - distance // 2
    flips = F.lit(None).cast("array<struct<flip:bigint,bits:int>>")
    for i, m in enumerate(masks):
        free = [b for b in range(BITS) if not m >> b & 1]
        options = [
            F.struct(F.lit(signed(sum(1 << b for b in chosen))).alias("flip"), F.lit(k).alias("bits"))
            for k in range(far + 1)
            for chosen in combinations(free, k)
        ]
        flips = F.when(F.col("mask") == i, F.array(*options)).otherwise(flips)
    halfway = many.select("fp", "mask", F.explode(flips).alias("to")).select(
        "fp", "mask", F.col("fp").bitwiseXOR(F.col("to.flip")).alias("half"), "to.bits"
    )
    centre = halfway.groupBy("mask", "half").agg(F.min(F.when(F.col("bits") <= near, F.col("fp"))).alias("b"))
    stars = halfway.join(centre, ["mask", "half"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).where(differing_bits("a", "b") <= distance)


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) for the distinct fingerprints: root names the class of all that links can reach."""
    distinct = work_table(prints.select("fp").where("fp IS NOT NULL").distinct())
    roots = components(links(distinct, distance))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


@keeps_own_columns
def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """Rows of `docs` with `fingerprint` and `component_id`, the smallest doc_id reachable by links.

    Fingerprints at `distance` or fewer differing bits link; equal ones always do, that of empty and
    null texts included. Copies are folded to one fingerprint before anything is paired. Repeated rows
    stay; rows without doc_id get their class's id, which is null if no row of the class has one.
    Columns of `docs` named like the added ones are replaced. An empty table gives an empty result.
    """
    rows = fresh(docs, "fingerprint", "component_id")
    return classify(rows.withColumn("_fp", fingerprint(F.col("text"), width)), distance)


def classify(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`near_duplicates` for rows whose fingerprint is in `_fp` already."""
    rows = work_table(rows)
    named = work_table(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("first")))
    member = named.join(classes(named, distance), "fp")
    ids = member.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = member.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(by_print, "_fp").withColumn("fingerprint", as_hex(F.col("_fp"))).drop("_fp")


@keeps_own_columns
def keep_one(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One row of `docs` for each class of near duplicates: that of the smallest doc_id.

    Rows without doc_id stand last; of repeated rows one stays. Columns are those of `docs`.
    """
    rows = work_table(
        docs.withColumn("_fp", fingerprint(F.col("text"), width)).withColumn("_row", F.monotonically_increasing_id())
    )
    best = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", F.col("_row").alias("row"))
    firsts = work_table(
        rows.groupBy(F.col("_fp").alias("fp")).agg(F.min_by(F.col("_row"), best).alias("row"), F.min(best).alias("best"))
    )
    winners = (
        firsts.join(classes(firsts, distance), "fp").groupBy("root").agg(F.min("best").alias("best"))
    ).select(F.col("best.row").alias("_row"))
    return rows.join(winners, "_row", "left_semi").select(*docs.columns)
