"""Shards of near equal bytes: range partition by sampled splitters."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emporia.llm.common import buckets_for, fresh, keeps_own_columns
from emporia.sources.store import work_table

SHARDS = 8
RANGES = 1024  # ranges that the splitters aim at; shards are cut between ranges
PER_RANGE = 16  # expected key samples in a range
CHUNK = 1 << 14  # consecutive row numbers that are counted together when repeated rows are numbered
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus one; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_key(text: Column) -> Column:
    """First part of the key: equal texts stand together."""
    return F.lpad(F.hex(F.xxhash64(text)), 16, "0")


def keyed(docs: DataFrame) -> DataFrame:
    """The range key, as text that sorts by text hash and then by row, the size and the checksum.

    What is taken from the text is taken here: where the text itself is not asked for, it is never shuffled.
    """
    text = F.col("text")
    row = F.lpad(F.hex(F.xxhash64("doc_id", "text", F.lit(1))), 16, "0")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return docs.withColumns({"_size": size_of(text), "_crc": crc, "_key": F.concat(text_key(text), row)})


def splitter_count(splitters: list[str], key: str) -> Column:
    """How many splitters are at most the key: its range, by binary search."""
    if not splitters:
        return F.lit(0)
    table = F.split(F.lit(",".join(splitters)), ",")  # folded to one constant
    steps = [1 << i for i in range(len(splitters).bit_length() - 1, -1, -1)]

    def advance(at: Column, step: Column) -> Column:
        onward = at + step
        return F.when(
            (onward <= len(splitters)) & (F.try_element_at(table, onward) <= F.col(key)), onward
        ).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), advance)


def sampled_keys(keys: DataFrame, rate: Column, draw: int) -> list[str]:
    """Keys of `keys` drawn in proportion to their size, `rate` draws a byte, sorted.

    The draw is a hash of the key and of the number of the draw, so reruns agree and each draw is a fresh
    one. The caller's rate bounds the number of draws.
    """
    sums = keys.groupBy("_key").agg(F.sum(F.col("_size") * rate).alias("_expected"))
    chance = F.pmod(F.xxhash64("_key", F.lit(draw)), F.lit(1 << 30)) / float(1 << 30)
    drawn = sums.select("_key", F.floor(F.col("_expected") + chance).cast("int").alias("_draws")).where("_draws > 0")
    return sorted(k for k, n in drawn.collect() for _ in range(n))


def single_keys(draws: list[str]) -> set[str]:
    """Splitters before and after every key that alone makes up about half a range or more."""
    often = {k for k, n in Counter(draws).items() if 2 * n >= PER_RANGE}
    return often | {k + "~" for k in often}


def whole_groups(splitters: list[str]) -> list[str]:
    """Splitters moved to the start of their group of equal texts, unless the group holds several."""
    starts: dict[str, int] = {}
    for s in splitters:
        starts[s[:16]] = starts.get(s[:16], 0) + 1
    return sorted({s[:16] if starts[s[:16]] == 1 else s for s in splitters} | {s[:16] for s in splitters})


def range_totals(keys: DataFrame, splitters: list[str]) -> dict[int, tuple[int, int, bool]]:
    """Bytes and rows of each range, and whether all its rows have one key."""
    ranges = keys.select(splitter_count(splitters, "_key").alias("at"), "_size", "_key")
    figures = F.sum("_size").alias("size"), F.count("*").alias("rows"), (F.min("_key") == F.max("_key")).alias("one")
    return {r["at"]: (r["size"], r["rows"], r["one"]) for r in ranges.groupBy("at").agg(*figures).collect()}


def splitters_for(
    keys: DataFrame, total: int, ranges: int = RANGES
) -> tuple[list[str], dict[int, tuple[int, int, bool]]]:
    """Splitters and the exact (bytes, rows, one key) of the ranges between them.

    Quantiles of a size-weighted sample of keys give the first splitters. A range that turns out to
    hold over twice its part of the bytes is sampled afresh, at a rate that gives each of the parts it
    should have been `PER_RANGE` keys, and subdivided, until only ranges of a single key are overfull.
    The driver sees about RANGES * PER_RANGE keys a draw and the totals of the ranges, at any size of the input.
    """
    if not total:
        return [], {}
    sample = sampled_keys(keys, F.lit(ranges * PER_RANGE / total), 0)
    splitters = sorted({*whole_groups(sample[PER_RANGE::PER_RANGE]), *single_keys(sample)})
    for draw in count(1):
        totals = range_totals(keys, splitters)
        overfull = {at: size for at, (size, _, one) in totals.items() if size > 2 * total / ranges and not one}
        if not overfull:
            break
        at = splitter_count(splitters, "_key")
        inside = keys.withColumn("_at", at).where(F.col("_at").isin(list(overfull)))
        parts = {at: -(-size * ranges // total) for at, size in overfull.items()}
        rates = [parts[at] * PER_RANGE / overfull[at] if at in parts else 0.0 for at in range(len(splitters) + 1)]
        again = sampled_keys(inside, F.element_at(F.lit(rates), F.col("_at") + 1), draw)
        more = ({*again[PER_RANGE // 2 :: PER_RANGE]} | single_keys(again)) - set(splitters)
        if not more:
            break
        splitters = sorted({*splitters, *more})
    return splitters, totals


def pieces_of_ranges(
    totals: dict[int, tuple[int, int, bool]], shards: int, hot: set[int]
) -> list[tuple[int, int, int, int, int]]:
    """(range, first row, row after the last, shard, slot of the first row) for ranges in order.

    Consecutive ranges share a shard; a range goes where the middle of its bytes falls. In a hot range, whose
    rows are all alike, every row goes where its own middle falls, so that the range is cut between rows.
    """
    total, before, pieces = sum(size for size, _, _ in totals.values()), 0, []
    slots: dict[int, int] = defaultdict(int)
    for at in sorted(totals):
        size, rows, _ = totals[at]
        parts, each = (rows, size // rows) if at in hot else (1, size)

        def begin(s: int) -> int:
            """The first part whose middle is in shard s or beyond."""
            return min(parts, max(0, -((shards * (2 * before + each) - 2 * total * s) // (2 * each * shards))))

        for s in range(shards):
            first, after = begin(s), begin(s + 1) if s + 1 < shards else parts
            if first < after:
                first, after = first * (rows // parts), after * (rows // parts)
                pieces.append((at, first, after, s, slots[s]))
                slots[s] += after - first
        before += size
    return pieces


def numbered_in_ranges(keys: DataFrame, rows: DataFrame, part: Column, order: str) -> DataFrame:
    """`rows` with `_row`, numbered from 0 in each range `_at`, part after part.

    `part` cuts a range, so that its rows are sorted in many tasks; `keys` holds the same parts of the same ranges.
    """
    before = Window.partitionBy("_home").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = keys.groupBy(F.col("_at").alias("_home"), part.alias("_part")).agg(F.count("*").alias("_rows"))
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inner = Window.partitionBy("_at", "_cut").orderBy(order)
    # Null-safe equality keeps the planner from inferring filters from the lambda in `_at`, which it gets wrong.
    same = F.col("_at").eqNullSafe(F.col("_home")) & F.col("_cut").eqNullSafe(F.col("_part"))
    return (
        rows.withColumn("_cut", part)
        .join(work_table(offsets), same)
        .withColumn("_row", F.col("_offset") + F.row_number().over(inner) - 1)
        .drop("_home", "_part", "_offset", "_cut")
    )


@keeps_own_columns
def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """Rows of `docs` with size, text_crc32, law, shard, slot and grown_shard.

    The law is `bytes`: the sizes of the shards are near equal, off by at most about a range (1/128 of a
    shard) or the longest document. Rows are range-partitioned by the hash of the text and then of the
    row, so that equal texts share a shard unless their group is too big for a range. `slot` counts a
    shard's rows from 0 without a gap. `grown_shard` is null under this law.

    A null text is empty. Repeated rows each get a slot of their own; which of two equal rows comes
    first is not defined and cannot be told. Rows equal in doc_id and text that together overfill a range are
    numbered in chunks and cut between shards like any others. Columns of `docs` named like the added
    ones are replaced, all others keep their names and values, also those named like inner ones; an
    empty table gives an empty result.
    """
    rows = keyed(fresh(docs, *ADDED))
    keys = work_table(rows.select("_key", "_size"))
    total = keys.agg(F.sum("_size")).first()[0] or 0
    splitters, totals = splitters_for(keys, total, ranges)
    hot = {at for at, (size, n, one) in totals.items() if one and n > 1 and size > 2 * total / ranges}
    pieces = docs.sparkSession.createDataFrame(
        pieces_of_ranges(totals, shards, hot), "_home int, _first bigint, _after bigint, shard int, _slot bigint"
    )
    at = splitter_count(splitters, "_key").alias("_at")
    is_hot = F.col("_at").isin(list(hot))
    # Ranges of very large inputs are cut by a hash, so that rows are numbered in many tasks.
    cuts = buckets_for(max([n for at, (_, n, _) in totals.items() if at not in hot], default=1))
    cut = F.pmod(F.xxhash64("_key", F.lit(3)), F.lit(cuts))
    placed = rows.select("*", at)
    numbered = numbered_in_ranges(keys.select("_key", at), placed.where(~is_hot) if hot else placed, cut, "_key")
    if hot:
        # Nothing tells these rows apart, so their numbers are stored with them.
        alike = work_table(placed.where(is_hot).withColumn("_id", F.monotonically_increasing_id()))
        chunk = F.shiftright("_id", CHUNK.bit_length() - 1)
        numbered = numbered.unionByName(numbered_in_ranges(alike, alike, chunk, "_id").drop("_id"))
    # A row or so per range, and per shard's end in a hot one: small enough to broadcast at any size of the input.
    inside = (F.col("_row") >= F.col("_first")) & (F.col("_row") < F.col("_after"))
    return (
        numbered.join(F.broadcast(pieces), F.col("_at").eqNullSafe(F.col("_home")) & inside)
        .withColumns(
            {
                "size": F.col("_size"),
                "text_crc32": F.col("_crc"),
                "law": F.lit("bytes"),
                "slot": F.col("_slot") + F.col("_row") - F.col("_first"),
                "grown_shard": F.lit(None).cast("int"),
            }
        )
        .drop("_at", "_home", "_first", "_after", "_slot", "_row", "_key", "_size", "_crc")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The shards as Parquet, a folder each."""
    shard(docs, shards).write.partitionBy("shard").parquet(path)
