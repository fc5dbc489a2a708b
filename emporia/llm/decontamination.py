"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporia.llm.common import unused
from emporia.sources.store import work_table

WINDOW = 13  # words of an overlap that counts
SUBSTITUTED = 2  # of them that may differ
# Every window of 13 words with up to two substitutions keeps one of these masks whole (see the tests).
MASKS = ((0, 3, 7, 8, 9, 10), (0, 1, 2, 3, 5, 6))
FILTER_BITS = 24  # the prefilter of training hashes has 2^24 bits, whatever the benchmark
PROBES = (40, 16, 0)  # shifts that give the bits of a hash in it
SLICE = 512  # documents hashed at once
CACHED_WORDS = 400_000
WORD = re.compile(r"\w+")


def allowed(n: int) -> int:
    """Substitutions in the window of an item of n words."""
    return SUBSTITUTED if n >= WINDOW else 1 if n >= 8 else 0


def masks_for(lengths: list[int]) -> list[tuple[int, ...]]:
    """The spaced masks, and for items shorter than a window whole runs: of two halves one is intact."""
    short = {n // 2 if allowed(n) else n for n in lengths if 0 < n < WINDOW}
    return [*MASKS, *[tuple(range(n)) for n in sorted(short)]]


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


HASHES = WordHashes()


def grams(text: str | None) -> np.ndarray:
    """The hashes of the lower-cased words of a text; punctuation and spaces do not count."""
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def seed_hashes(values: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of the words under the mask at every place where it fits."""
    n = max(0, len(values) - mask[-1])
    total = np.zeros(n, np.uint64)
    for k, at in enumerate(mask):
        factor = np.uint64(xxhash.xxh64_intdigest(f"{len(mask)}:{k}") | 1)
        total += values[at : at + n] * factor
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


def item_grams(items: DataFrame) -> DataFrame:
    """(item, item_id, grams) of distinct item texts that have a word, each under its smallest id, which may be
    null. `item` numbers them; the table is stored, so the numbers hold.
    """

    @F.pandas_udf("array<bigint>")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: grams(t).view(np.int64))

    rows = items.select("item_id", hashed("text").alias("grams"))
    texts = rows.groupBy("grams").agg(F.min("item_id").alias("item_id")).where(F.size("grams") > 0)
    return work_table(texts.withColumn("item", F.monotonically_increasing_id()))


def item_seeds(items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(mask, hash, item, at): where the masked words of an item stand in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, values in zip(batch["item"], batch.grams):
                values = np.asarray(values, np.int64).view(np.uint64)
                for k, mask in enumerate(masks):
                    run_of = len(values) // 2 if allowed(len(values)) else len(values)
                    if (k < len(MASKS)) != (len(values) >= WINDOW) or (k >= len(MASKS) and len(mask) != run_of):
                        continue
                    found = seed_hashes(values, mask).view(np.int64)
                    yield pd.DataFrame({"mask": k, "hash": found, "item": item, "at": np.arange(len(found))})

    return items.select("item", "grams").mapInPandas(run, "mask int, hash bigint, item bigint, at int")


def prefilter(seeds: DataFrame) -> np.ndarray:
    """A bitmap of three bits for each of the benchmark's hashes: 2 MB at most, also on the driver."""
    places = [F.shiftrightunsigned("hash", n).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for n in PROBES]
    top = F.col("top").cast("int")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1), top % 8))
    marked = seeds.select(F.explode(F.array(*places)).alias("top"))
    rows = marked.groupBy(F.shiftright(top, 3).alias("byte")).agg(bits.alias("bits")).toPandas()
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    bitmap[rows.byte.to_numpy(np.int64)] = rows.bits.to_numpy(np.uint8)
    return bitmap


def probed(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Places of the hashes all of whose bits are set."""
    places = np.arange(len(hashes))
    for n in PROBES:
        top = (hashes[places] >> np.uint64(n)) & np.uint64((1 << FILTER_BITS) - 1)
        places = places[bitmap[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8) & 1 == 1]
    return places


def possible_hits(docs: DataFrame, masks: list[tuple[int, ...]], bitmap: np.ndarray) -> DataFrame:
    """Documents with masked hashes that may be in the benchmark: grams, and mask, place and hash of each."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("key", pa.int64()),
            ("grams", pa.list_(pa.int64())),
            ("masks", pa.list_(pa.int32())),
            ("places", pa.list_(pa.int32())),
            ("hashes", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            # Documents stand behind one another, so that whole batches are hashed at once.
            each = [grams(t) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([len(g) for g in each])
            values = np.concatenate(each) if each else np.zeros(0, np.uint64)
            found = []
            for k, mask in enumerate(masks):
                hashes = seed_hashes(values, mask)
                hit = probed(hashes, bitmap)
                doc = np.searchsorted(ends, hit, side="right")
                inside = hit + mask[-1] < ends[doc] if len(hit) else np.zeros(0, bool)
                found.append((doc[inside], np.full(inside.sum(), k), hit[inside], hashes[hit[inside]]))
            doc, mask_of, at, hashes = (np.concatenate(x) for x in zip(*found))
            if not len(doc):
                continue
            order = np.argsort(doc, kind="stable")
            doc, mask_of, at, hashes = doc[order], mask_of[order], at[order], hashes[order].view(np.int64)
            chosen, first = np.unique(doc, return_index=True)
            cut = [*first.tolist(), len(doc)]
            spans = list(zip(cut, cut[1:]))
            starts = ends - [len(g) for g in each]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(chosen, pa.int64())).cast(pa.int64()),
                    batch.column("key").take(pa.array(chosen, pa.int64())),
                    pa.array([each[d].view(np.int64) for d in chosen], pa.list_(pa.int64())),
                    pa.array([mask_of[a:b] for a, b in spans], pa.list_(pa.int32())),
                    pa.array([at[a:b] - starts[d] for d, (a, b) in zip(chosen, spans)], pa.list_(pa.int32())),
                    pa.array([hashes[a:b] for a, b in spans], pa.list_(pa.int64())),
                ],
                schema=schema,
            )

    out = "doc_id bigint, key bigint, grams array<bigint>, masks array<int>, places array<int>, hashes array<bigint>"
    return docs.mapInArrow(run, out)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """First word, words and matching words of the windows that agree when item word i meets
    document word i + shift; None without one."""
    window = min(WINDOW, len(item))
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high - low < window:
        return None
    same = item[low:high] == doc[low + shift : high + shift]
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.nonzero(sums[window:] - sums[:-window] >= window - allowed(len(item)))[0]
    if not len(good):
        return None
    covered = np.zeros(len(same) + 1, np.int64)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + window, -1)
    covered = np.cumsum(covered[:-1]) > 0
    return low + shift + int(good[0]), int(covered.sum()), int((covered & same).sum())


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, first_word, n_words, n_matches): documents that hold part of an item.

    A part is a window of 13 consecutive words of which at most two are substituted; for an item of
    8 to 12 words all but one, of 1 to 7 words all of them. Items without a word are in no document.
    Masks that ignore some positions are hashed at every place of items and documents and the hashes are
    joined; around each hit the two texts are laid against one another and the windows verified. A bitmap
    of fixed size drops, inside the scan, hashes that are in no item; it never decides by itself.

    One row per document row and distinct item text (under its smallest item_id, null if it has none): the
    alignment with most matching words. Null and empty texts hold nothing. `key` tells rows with the same
    doc_id apart; rows equal in doc_id and text each have their own rows. Empty tables give no rows.
    """
    found = item_grams(items)
    lengths = [r[0] for r in found.select(F.size("grams")).where(F.size("grams") < WINDOW).distinct().collect()]
    masks = masks_for(lengths)
    seeds = work_table(item_seeds(found, masks))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    likely = work_table(possible_hits(rows, masks, prefilter(seeds)).withColumn("row", F.monotonically_increasing_id()))
    hits = likely.select("row", F.explode(F.arrays_zip("masks", "places", "hashes")).alias("h")).select(
        "row", F.col("h.masks").alias("mask"), F.col("h.hashes").alias("hash"), F.col("h.places").alias("place")
    )
    laid = (
        hits.join(seeds, ["mask", "hash"])
        .select("row", "item", (F.col("place") - F.col("at")).alias("shift"))
        .distinct()
    )

    @F.pandas_udf("struct<first_word:bigint,n_words:bigint,n_matches:bigint>")
    def verified(doc: pd.Series, item: pd.Series, shift: pd.Series) -> pd.DataFrame:
        results = [overlap(d, i, s) or (None, None, None) for d, i, s in zip(doc, item, shift)]
        return pd.DataFrame(results, columns=["first_word", "n_words", "n_matches"]).astype("Int64")

    checked = (
        laid.join(likely.select("row", "doc_id", "key", F.col("grams").alias("doc_grams")), "row")
        .join(found, "item")
        .select("row", "doc_id", "key", "item", "item_id", verified("doc_grams", "grams", "shift").alias("v"))
    )
    best = F.max(F.struct("v.n_matches", "v.n_words", (-F.col("v.first_word")).alias("back"))).alias("b")
    return (
        checked.where("v.n_words IS NOT NULL")
        .groupBy("row", "doc_id", "key", "item", "item_id")
        .agg(best)
        .select(
            "doc_id", "key", "item_id", (-F.col("b.back")).alias("first_word"), "b.n_words", "b.n_matches"
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of `docs` that hold no part of an item, with the columns of `docs`."""
    key = unused(docs, "key")
    held = work_table(overlaps(docs, items).select(F.col("key").alias(key)).distinct())
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return rows.join(held, key, "left_anti").select(*docs.columns)
