"""Cross-entropy difference of two matched bigram models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporia.llm.common import fresh, keeps_own_columns, word_count
from emporia.sources.store import work_table

PRIOR = 20.0  # weight of the unigram model in a bigram's probability, in tokens
HELD_WORDS = 500_000  # distinct words counted in a task before they are handed on
CHUNK_WORDS = 500_000  # words whose pairs are gathered in a task before they are handed on
CHUNK_DOCS = 50_000
BUCKET_WORDS = 2_000_000  # words whose pairs meet in one task
PARTS = "bucket int, kind int, chunk bigint, keys binary, w binary, w_len binary, v binary, v_len binary, doc binary, n binary"
TARGET, BACKGROUND, DOCS, SHARED, KEYS = range(5)  # kinds of parts; shared texts are scored and the background too
ADDED = ("n_tokens", "target_loss", "background_loss", "score")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_totals(target: DataFrame, background: DataFrame) -> DataFrame:
    """(word, t, b): the hash of every word of the two corpora and its counts in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            hashes = hashes_of(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > HELD_WORDS:
                    yield rows()
                    counts = Counter()
        yield rows()

    none = F.lit(0).cast("long")
    t, b = (x.mapInArrow(run, "word bigint, n bigint") for x in (target, background))
    both = t.select("word", F.col("n").alias("t"), none.alias("b")).unionByName(
        b.select("word", none.alias("t"), F.col("n").alias("b"))
    )
    return both.groupBy("word").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


class Numbers(dict):
    """Numbers of the words of a chunk, in order of appearance; 0 and 1 are marks."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self) + 2
        return value


def hashes_of(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of a pair of hashes."""
    result = v * np.uint64(0x9E3779B97F4A7C15) + w
    result ^= result >> np.uint64(32)
    result *= np.uint64(0xD6E8FEB86659FD93)
    return result ^ (result >> np.uint64(32))


def places_in(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the values are in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def parts(texts: DataFrame, kind: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """The word pairs of `texts` (key, text), packed in rows of `PARTS`, one for a chunk and bucket.

    A row lists its words `w`, for each the words `v` before it, and for each of these the documents (places in
    the chunk) with the pair's number in them; one row more has the keys of the chunk's documents. The word before as such is listed as well, as the pair of mark 0 and
    it. All pairs of a word go to one bucket; those of a hot word are spread over the buckets.
    """
    scored = kind in (DOCS, SHARED)

    def packed(
        chunk: int, numbers: Numbers, ids: list[int], sizes: list[int], keys: list[int]
    ) -> Iterator[pa.RecordBatch]:
        flat, lengths = np.array(ids, np.int64), np.array(sizes, np.int64) + 1
        firsts = np.cumsum(lengths) - lengths  # places of the start marks, which end no pair
        w, v = np.delete(flat, firsts), np.delete(np.concatenate(([0], flat[:-1])), firsts)
        doc = np.repeat(np.arange(len(sizes)) if scored else np.zeros(len(sizes), np.int64), lengths - 1)
        bits, below = int(len(numbers) + 2).bit_length(), len(sizes).bit_length()
        each = np.concatenate(((((w << bits) | v) << below) | doc, ((v << (bits + below)) | doc)))
        each, n = np.unique(each, return_counts=True)
        hashes = np.concatenate((np.array([0, 1], np.uint64), hashes_of(numbers)))
        doc, pair = each & ((1 << below) - 1), each >> below
        w, v = hashes[pair >> bits], hashes[pair & ((1 << bits) - 1)]
        bucket = np.where(places_in(w, hot)[0], mixed(v, w), w) % np.uint64(buckets)
        order = np.argsort(bucket.astype(np.uint32), kind="stable")
        bucket, w, v, doc, n, pair = (x[order] for x in (bucket, w, v, doc, n, pair))
        cuts = np.concatenate((np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]))
        start, rows = 0, []
        if scored:
            rows.append((chunk % buckets, KEYS, chunk, np.array(keys, "<i8").tobytes(), *[b""] * 6))
        for end in cuts[cuts > 0].tolist():
            new = np.concatenate(([0], np.nonzero(np.diff(pair[start:end]))[0] + 1))
            ww = w[start:end][new]
            word = np.concatenate(([0], np.nonzero(np.diff(ww))[0] + 1))
            rows.append(
                (
                    int(bucket[start]),
                    kind,
                    chunk,
                    b"",
                    ww[word].tobytes(),
                    np.diff(word, append=len(ww)).astype("<u4").tobytes(),
                    v[start:end][new].tobytes(),
                    np.diff(new, append=end - start).astype("<u4").tobytes(),
                    doc[start:end].astype("<u2").tobytes(),
                    n[start:end].astype("<u4").tobytes(),
                )
            )
            start = end
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 7]
        names = ["bucket", "kind", "chunk", "keys", "w", "w_len", "v", "v_len", "doc", "n"]
        for i in range(0, len(rows), 64):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), types)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        numbers, ids, sizes, keys = Numbers(), [], [], []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                ids.append(1)
                ids.extend(map(numbers.__getitem__, words))
                sizes.append(len(words))
                keys.append(key)
                if len(ids) >= CHUNK_WORDS or len(sizes) >= CHUNK_DOCS:
                    yield from packed(chunk, numbers, ids, sizes, keys)
                    chunk += 1
                    numbers, ids, sizes, keys = Numbers(), [], [], []
        if sizes:
            yield from packed(chunk, numbers, ids, sizes, keys)

    return texts.mapInArrow(run, PARTS)


def loss_sums(gathered: DataFrame, hot: np.ndarray, hot_counts: np.ndarray, words: tuple[int, int], known: int) -> DataFrame:
    """(key, t, b): the sums of the losses of a document's words; a row for each document with words.

    `hot_counts` has the counts of hot words in either corpus, `words` the words of these, `known` the classes.
    """
    scales = (1.0, words[0] / words[1] if words[0] and words[1] else 1.0)

    def column(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
        return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]

    def run(table: pa.Table) -> pa.Table:
        is_keys = table.column("kind").to_numpy() == KEYS
        keyed = table.filter(pa.array(is_keys))
        out = [(c, k, b"", b"", b"") for c, k in zip(keyed.column("chunk").to_pylist(), keyed.column("keys").to_pylist())]
        table = table.filter(pa.array(~is_keys))
        if table.num_rows:
            out += in_bucket(table)
        columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *[pa.binary()] * 4])]
        return pa.table(columns, names=["chunk", "keys", "doc", "t", "b"])

    def in_bucket(table: pa.Table) -> list[tuple]:
        kinds, v = table.column("kind").to_numpy(), column(table, "v", "<u8")
        pairs = np.array([len(x) for x in v])
        w = np.concatenate([np.repeat(x, k) for x, k in zip(column(table, "w", "<u8"), column(table, "w_len", "<u4"))])
        v, v_len = np.concatenate(v), np.concatenate(column(table, "v_len", "<u4"))
        n = np.concatenate(column(table, "n", "<u4"))
        kind, before = np.repeat(kinds.astype(np.int8), pairs), v == 0
        numbers = np.add.reduceat(n, np.cumsum(v_len, dtype=np.int64) - v_len, dtype=np.float64)
        which = np.unique(mixed(v, w), return_inverse=True)[1].astype(np.int32)
        del v
        words_at = np.unique(w, return_inverse=True)[1].astype(np.int32)
        is_hot, at = places_in(w, hot)
        del w
        doc = column(table, "doc", "<u2")
        tops = np.array([int(x.max()) + 1 for x in doc])
        starts = np.cumsum(tops) - tops
        doc = np.concatenate([x + np.int64(start) for x, start in zip(doc, starts)])
        sums, size = [], int(tops.sum())
        for k, kinds_of in enumerate(((TARGET,), (BACKGROUND, SHARED))):
            own = np.where(np.isin(kind, kinds_of), numbers, 0)
            count = np.bincount(which, own)[which]
            own[before] = 0
            single = np.bincount(words_at, own)[words_at]
            if len(hot):
                single = np.where(is_hot, hot_counts[at, k], single)
            single = PRIOR * (single * scales[k] + 1) / (words[k] * scales[k] + known)
            single[before] = PRIOR
            lost = np.log(count * scales[k] + single)
            del own, count, single
            lost[~before] *= -1
            lost = np.repeat(lost, v_len)
            lost *= n
            sums.append(np.bincount(doc, lost, size))
            del lost
        there, out = np.bincount(doc, minlength=size) > 0, []
        for kind, chunk, start, top in zip(kinds, table.column("chunk").to_pylist(), starts, tops):
            if kind in (DOCS, SHARED):
                found = np.nonzero(there[start : start + top])[0]
                t, b = (x[start + found].astype("<f4").tobytes() for x in sums)
                out.append((chunk, b"", found.astype("<u2").tobytes(), t, b))
        return out

    def in_chunk(table: pa.Table) -> pa.Table:
        keys, doc = (np.concatenate(column(table, *x)) for x in (("keys", "<i8"), ("doc", "<u2")))
        t, b = (np.bincount(doc, np.concatenate(column(table, x, "<f4")), len(keys)) for x in "tb")
        return pa.table({"key": keys, "t": t, "b": b})

    packed = gathered.groupBy("bucket").applyInArrow(
        run, "chunk bigint, keys binary, doc binary, t binary, b binary"
    )
    return packed.groupBy("chunk").applyInArrow(in_chunk, "key bigint, t double, b double")


@keeps_own_columns
def score(docs: DataFrame, target: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """Rows of `docs` with n_tokens, target_loss, background_loss (nats per word) and score.

    The corpora are tables of one text column; without a background, the texts of `docs` are it. All words and
    word pairs of both corpora are counted, and all words of a text scored; only a word that is in neither
    is unknown. Pairs travel as 64-bit hashes to where their counts meet, and sums per document travel back; no
    table of words or pairs is held whole.

    The score is the mean loss difference per word, background less target: above 0 a text looks
    more like the target. A null or blank text has losses and score 0. Repeated rows are scored alike.
    Columns named like the added ones are replaced. Without a target, or without rows, the result is whole all the same.
    """
    rows = fresh(docs, *ADDED).withColumn("_key", F.xxhash64("doc_id", "text"))
    own = docs.select("text") if background is None else background
    totals = work_table(word_totals(target, own))
    zero = F.lit(0)
    words_t, words_b, distinct = totals.agg(
        F.coalesce(F.sum("t"), zero), F.coalesce(F.sum("b"), zero), F.count("*")
    ).first()
    words = words_t + words_b
    if background is not None:
        words += docs.agg(F.coalesce(F.sum(word_count(F.col("text"))), zero)).first()[0]
    buckets = -(-words // BUCKET_WORDS) or 1
    # Words with over an eighth of a bucket are hot: at most eight for each bucket.
    hot = totals.where(F.col("t") + F.col("b") > words / (8 * buckets)).select("word", "t", "b").toPandas()
    hashes = hot["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], hot[["t", "b"]].to_numpy(np.float64)[order]
    unkeyed = F.lit(0).cast("long").alias("_key")
    gathered = parts(target.select(unkeyed, target[0].alias("text")), TARGET, buckets, hashes)
    if background is not None:
        gathered = gathered.unionByName(
            parts(background.select(unkeyed, background[0].alias("text")), BACKGROUND, buckets, hashes)
        )
    asked = parts(rows.select("_key", "text"), SHARED if background is None else DOCS, buckets, hashes)
    sums = loss_sums(gathered.unionByName(asked), hashes, counts, (words_t, words_b), distinct + 2)
    # Rows equal in (doc_id, text) share a key and have equal sums.
    each = sums.groupBy(F.col("key").alias("_of")).agg(F.max("t").alias("_t"), F.max("b").alias("_b"))
    losses_of = [F.coalesce(F.col(c) / F.nullif("n_tokens", F.lit(0)), F.lit(0.0)) for c in ("_t", "_b")]
    return (
        rows.withColumn("n_tokens", word_count(F.col("text")))
        .join(each, F.col("_key") == F.col("_of"), "left")
        .select(
            *[c for c in rows.columns if c != "_key"],
            "n_tokens",
            losses_of[0].alias("target_loss"),
            losses_of[1].alias("background_loss"),
            (losses_of[1] - losses_of[0]).alias("score"),
        )
    )
