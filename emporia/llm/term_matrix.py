"""A sparse document-term matrix under one dictionary: CSR shards over globally numbered words."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporia.llm.common import buckets_for
from emporia.sources.store import work_table

SHARD_WORDS = 4_000_000  # words after which a shard is closed at the next document's end
BUCKET_ENTRIES = 400_000  # shard dictionary entries that are numbered in one task
SYMBOLS = b"#$%&*|"
UPPER, SYMBOL = 4, 8  # bits of `marks`: too many capitals, holds a symbol

LOCAL = (
    "shard bigint, words array<string>, doc_ids array<bigint>, parts array<string>, marks array<int>,"
    " digests array<binary>, row_words array<bigint>, row_terms array<bigint>, terms binary, counts binary"
)
ROWS = "doc_id bigint, part string, marks int, digest binary, n_words bigint, n_distinct bigint"


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1)


class ShardBuilder:
    """The rows of one shard, with terms numbered in the order in which the shard first meets them."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.rows: list[tuple] = []
        self.row_words: list[int] = []
        self.row_terms: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, part: str, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        found = Counter(raw.split())  # splits at the white space of the word rule
        number = self.number
        terms = [number.setdefault(w, len(number)) for w in found]
        counts = np.fromiter(found.values(), np.uint32, len(found))
        self.terms.append(np.array(terms, np.uint32))
        self.counts.append(counts)
        n = int(counts.sum())
        self.row_words.append(n)
        self.row_terms.append(len(terms))
        self.rows.append((doc_id, part, marks_of(raw), hashlib.sha256(raw).digest()))
        self.held += n + 1

    def batch(self, shard: int) -> pa.RecordBatch:
        doc_ids, parts, marks, digests = map(list, zip(*self.rows))
        values = [
            shard, [w.decode("utf-8", "surrogatepass") for w in self.number], doc_ids, parts, marks, digests,
            self.row_words, self.row_terms, packed(np.concatenate(self.terms)), packed(np.concatenate(self.counts)),
        ]
        whole, texts = pa.list_(pa.int64()), pa.list_(pa.string())
        kinds = [pa.int64(), texts, whole, texts, pa.list_(pa.int32()), pa.list_(pa.binary()), whole, whole, pa.binary(), pa.binary()]
        names = [field.split()[0] for field in LOCAL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def marks_of(raw: bytes) -> int:
    """Bits of what is told from the characters: capitals over 2 % of the code points, any symbol."""
    data = np.frombuffer(raw, np.uint8)
    points = len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))
    capitals = int(np.count_nonzero((data - 65).astype(np.uint8) < 26))
    return UPPER * (100 * capitals > 2 * points) + SYMBOL * any(bytes([s]) in raw for s in SYMBOLS)


def local_shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Stretches of `docs` (doc_id, part, text) as CSR rows under a dictionary of their own.

    Nothing is shuffled. A document is split and counted once; its terms and counts are kept packed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, shard = TaskContext.get().partitionId() << 32, 0, ShardBuilder()
        for batch in batches:
            for row in zip(*[batch.column(n) for n in ("doc_id", "part", "text")]):
                shard.add(*[v.as_py() for v in row])
                if shard.held >= shard_words:
                    yield shard.batch(first + made)
                    made, shard = made + 1, ShardBuilder()
        if shard.rows:
            yield shard.batch(first + made)

    return docs.select("doc_id", "part", "text").mapInArrow(run, LOCAL)


class TermMatrix:
    """`dictionary`: (word, term), terms being 0 to size - 1; `shards`: CSR rows under these numbers.

    Every shard has doc_ids, parts, marks and digests of its rows, `row_words` and `row_terms` (words and
    stored entries of each row), and the entries: `terms` (32 or 64 bits, as `wide` says) and `counts`.
    """

    def __init__(self, local: DataFrame, numbered: DataFrame, offsets: DataFrame, size: int):
        self.local, self.numbered, self.offsets, self.size = local, numbered, offsets, size

    @property
    def dictionary(self) -> DataFrame:
        found = self.numbered.where("first").join(self.offsets, "bucket")
        return found.select("word", (F.col("before") + F.col("rank")).alias("term"))

    def numbers(self) -> DataFrame:
        """(shard, own, terms): a stretch of a shard's own numbers with the global ones."""
        found = self.numbered.join(self.offsets, "bucket")
        return found.select("shard", "own", (F.col("before") + F.col("rank")).alias("term"))

    def map_shards(self, function, schema: str) -> DataFrame:
        """`function(shard row as dict, global terms of all entries, counts) -> RecordBatch` for every shard."""

        def run(shard: pa.Table, numbers: pa.Table) -> pa.Table:
            of = np.empty(numbers.num_rows, np.int64)
            of[numbers.column("own").to_numpy()] = numbers.column("term").to_numpy()
            row = shard.to_pylist()[0]
            n = sum(row["row_terms"])
            return pa.Table.from_batches([function(row, of[unpacked(row["terms"], n)], unpacked(row["counts"], n))])

        rows = self.local.drop("words").groupBy("shard")
        return rows.cogroup(self.numbers().groupBy("shard")).applyInArrow(run, schema)

    def row_statistics(self) -> DataFrame:
        """A row for every document: row sums and nonzero counts of the matrix, and what its shard keeps of it."""

        def rows(row: dict, terms: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            indptr = np.concatenate(([0], np.cumsum(row["row_terms"]))).astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[indptr]
            present = np.concatenate(([0], np.cumsum((counts > 0) & (terms >= 0), dtype=np.int64)))[indptr]
            columns = [
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["parts"], pa.string()), pa.array(row["marks"], pa.int32()),
                pa.array(row["digests"], pa.binary()), pa.array(np.diff(sums)), pa.array(np.diff(present)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in ROWS.split(", ")])

        return self.map_shards(rows, ROWS)


def build(docs: DataFrame, shard_words: int = SHARD_WORDS) -> TermMatrix:
    """The document-term matrix of `docs` (doc_id, part, text; text and part not null).

    Words are runs of other than ASCII white space. Every shard first numbers its own words; only these
    short dictionaries are shuffled. A word's number is the sum of the sizes of the buckets before
    that of its hash, plus its rank in its bucket: the same in every run, whatever is computed again. A
    very common word has one entry per shard. An empty table gives an empty matrix.
    """
    local = work_table(local_shards(docs, shard_words), compression="zstd")
    entries = local.select("shard", F.posexplode("words").alias("own", "word"))
    total = local.agg(F.sum(F.size("words").cast("long"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets_for(total, BUCKET_ENTRIES))).cast("int")
    by_word = Window.partitionBy("bucket").orderBy("word")
    numbered = work_table(
        entries.withColumn("bucket", bucket)
        .withColumn("rank", F.dense_rank().over(by_word).cast("long") - 1)
        .withColumn("first", F.coalesce(F.lag("word").over(by_word) != F.col("word"), F.lit(True)))
        .select("shard", "own", "bucket", "rank", "first", F.when(F.col("first"), F.col("word")).alias("word")),
        compression="zstd",
    )
    sizes = numbered.groupBy("bucket").agg((F.max("rank") + 1).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = work_table(sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), "size"))
    size = offsets.agg(F.sum("size")).first()[0] or 0
    return TermMatrix(local, numbered, offsets, size)
