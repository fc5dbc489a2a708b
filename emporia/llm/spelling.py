"""Spelling variants: words one edit apart, found by dense tiles of padded code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporia.sources.store import work_table

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7  # code points of a word
LEAST_COUNT = 2
FORM_RATIO = 10  # a form is at least so many times as frequent
NOISE = 31  # one in so many (document, run) pairs loses a letter
WINDOW = 3  # letters of a word that its block leaves out, and so the bound of a block: alphabet ** WINDOW
WINDOWS = 8  # windows of a word at most; those of words beyond WINDOW * WINDOWS letters are wider
CELLS = 1 << 21  # code points compared at once

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TILES = "word string, n bigint, near bigint, best string, best_n bigint"


def occurrences(docs: DataFrame) -> DataFrame:
    """(word): one row for every run of letters in `docs` (doc_id, text) that is long enough as a word.

    Only A-Z are lower-cased. Where NOISE divides the CRC-32 of `<doc_id>:<run>`, the run loses its code
    point at that number modulo its length. A null doc_id is written as nothing; a null text has no runs.
    """
    long_runs = F.regexp_extract_all("text", F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(long_runs).alias("run"))
    runs = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    word = F.expr(
        f"CASE WHEN h % {NOISE} = 0 THEN concat(left(run, int(h % length(run))), substr(run, int(h % length(run)) + 2)) ELSE run END"
    )
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough; occurrences are summed before the shuffle."""
    return occurrences(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def window_width(m: Column) -> Column:
    return F.greatest(F.lit(WINDOW), F.ceil(m / WINDOWS).cast("int"))


def blocks(words: DataFrame) -> DataFrame:
    """(m, key, i, width, word, n): the blocks of every word, as the longer word of a pair and as the shorter.

    A pair whose longer word has m letters agrees in all but one place. Cut into windows, m letters have
    one that holds this place: both words have the letters before the window, and, counted from their
    ends, those after it. Their hash is the block's key, so that a block holds no more words than
    there are ways to fill a window.
    """
    sizes = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") + 1)))
    sizes = sizes.withColumn("width", window_width(F.col("m")))
    placed = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / F.col("width")).cast("int") - 1)))
    rest = "m - least((i + 1) * width, m)"
    key = F.expr(f"xxhash64(m, i, left(word, i * width), right(word, {rest}))")
    return placed.select("m", key.alias("key"), "i", "width", "word", "n")


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words as padded matrices, set left and set right, and their lengths."""
    text = np.array(words, np.str_)
    width = text.dtype.itemsize // 4
    left = text.view(np.uint32).reshape(len(words), width)
    if left.max(initial=0) < 256:
        left = left.astype(np.uint8)
    sizes = np.char.str_len(text).astype(np.int64)
    places = np.arange(width) - (width - sizes)[:, None]
    right = np.where(places >= 0, np.take_along_axis(left, np.maximum(places, 0), axis=1), 0)
    return left, right, sizes


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the rows; the width for equal rows."""
    differs = a != b
    return np.where(differs.any(axis=1), differs.argmax(axis=1), a.shape[1])


def single_edits(words: list[str], runs: np.ndarray, m: np.ndarray, i: np.ndarray, width: np.ndarray):
    """Index pairs of words in the same run that are one edit apart and due in this block.

    Tiles of the matrix are compared with the rows 1, 2, 3, ... below, as far as runs reach. One
    edit is what common prefix and suffix tell that reach the longer length less one. A pair is
    given by the block whose window holds its first difference, and by no other.
    """
    left, right, sizes = code_points(words)
    backwards = right[:, ::-1]
    longest = len(words) - 1
    rows, down, found = np.arange(longest), 0, []
    while len(rows):
        down += 1
        rows = rows[rows + down <= longest]
        rows = rows[runs[rows] == runs[rows + down]]
        step = max(1, CELLS // left.shape[1])
        for at in range(0, len(rows), step):
            a = rows[at : at + step]
            b = a + down
            prefix, suffix = common(left[a], left[b]), common(backwards[a], backwards[b])
            longer = np.maximum(sizes[a], sizes[b])
            good = (longer == m[a]) & (prefix < longer) & (prefix + suffix >= longer - 1) & (prefix // width[a] == i[a])
            found.append((a[good], b[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def tile(words: list[str], n: np.ndarray, runs: np.ndarray, m: np.ndarray, i: np.ndarray, width: np.ndarray) -> pa.RecordBatch:
    """For each word with near words in these blocks: how many, and the best of them."""
    a, b = single_edits(words, runs, m, i, width)
    own, other = np.concatenate([a, b]), np.concatenate([b, a])
    names, number = np.unique(np.array(words, object), return_inverse=True)  # numbers in code-point order
    counts = np.zeros(len(names), np.int64)
    counts[number] = n
    own, other = number[own], number[other]
    order = np.lexsort((other, -counts[other], own))
    own, other = own[order], other[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    near = np.diff(np.append(first, len(own)))
    own, other = own[first], other[first]
    columns = [
        pa.array(names[own], pa.string()), pa.array(counts[own]), pa.array(near.astype(np.int64)),
        pa.array(names[other], pa.string()), pa.array(counts[other]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in TILES.split(", ")])


def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (m, key): whole blocks are handed to `tile`, the last one of a batch is held back."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, rows]) if held is not None else rows
        keys, sizes = held.column("key").to_numpy(), held.column("m").to_numpy()
        cut = np.flatnonzero((keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1]))
        if len(cut):
            end = int(cut[-1]) + 1
            yield from tiles_of(held.slice(0, end))
            held = held.slice(end)
    if held is not None:
        yield from tiles_of(held)


def tiles_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    m, key = rows.column("m").to_numpy(), rows.column("key").to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (m[1:] != m[:-1]))))
    sizes = np.diff(np.append(starts, len(key)))
    runs = np.repeat(np.arange(len(starts)), sizes)
    paired = np.flatnonzero(np.repeat(sizes > 1, sizes))  # a word alone in its block has nothing to be compared with
    if len(paired):
        pick = rows.take(paired)
        yield tile(
            pick.column("word").to_pylist(), pick.column("n").to_numpy(), runs[paired],
            *[pick.column(c).to_numpy() for c in ("m", "i", "width")],
        )


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) for `words` (word, n; distinct): how many others are exactly one
    insertion, deletion or replacement away, and the most frequent of these (ties: smallest by code point).
    """
    found = (
        blocks(words).repartition("m", "key").sortWithinPartitions("m", "key").mapInArrow(compare_blocks, TILES)
    )
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("long").alias("best_n"))
    best = F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("word"))
    return (
        found.unionByName(alone)
        .groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), best)).alias("top"))
        .select("word", "n", "n_near", F.col("top.word").alias("best"), (-F.col("top.least")).alias("best_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms` (word, form): the end of each chain, found by doubling.

    Counts grow FORM_RATIO times with each step, so chains are short.
    """
    at = work_table(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("middle"), F.col("root").alias("onward"))
        further = at.join(onward, F.col("root") == F.col("middle"), "left")
        moved = work_table(further.select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for the words of `docs` (doc_id, text).

    A word's form is its best near word if that is FORM_RATIO times as frequent, its root the form's
    form and so on, itself if it has none. Repeated rows count each; other columns are not looked at;
    an empty table has no words.
    """
    near = neighbours(work_table(vocabulary(docs)))
    has = F.col("best_n") >= FORM_RATIO * F.col("n")
    rows = work_table(
        near.select("word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    )
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
