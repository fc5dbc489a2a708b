"""Token ids in Huffman-coded files with checkpoints."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emporia.sources.store import scratch_path

END_ID = 2
LIMIT = 16  # longest code in bits; the decoding table has 2^16 entries
BLOCK_IDS = 1 << 18  # ids after which a block is closed at the next document's end
EVERY = 128  # ids between two checkpoints
CACHED_PIECES = 1_000_000
SLICE = 2048  # documents whose pieces are held at once
JOINED = 512  # unseen pieces encoded in one call

# Texts with other white space than this, with the special token or with the mark are encoded in one piece.
PLAIN = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
ODD = (
    "\x03", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)),
    "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "<|endoftext|>",
)
RUNS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")
INNER = ("\n\n", " \n", "\t", "\r", "\x0b", "\x0c")  # beside these a line feed may be part of a longer token
ALONE = "\x03"  # begins the name of a piece that no space stands before


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Pieces(dict):
    """Ids of pieces in two generations: what was asked for of late, and what had been before.

    Beyond half of CACHED_PIECES the younger generation becomes the older one, so that frequent pieces stay.
    """

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def __missing__(self, name: str) -> bytes:
        self[name] = ids = self.older[name]
        return ids

    def holds(self, name: str) -> bool:
        return name in self or name in self.older

    def make_room(self) -> None:
        if len(self) > CACHED_PIECES // 2:
            self.older = dict(self)
            self.clear()


class Encoder:
    """Ids of texts as little-endian bytes, by the tokenizers library.

    The vocabulary's pre-tokenizer never joins a character with a space that follows it, so what stands
    between is encoded alone and remembered; most words of a corpus are seen again and again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.bytes_of = np.zeros(self.size, np.int64)  # a character of a byte-level token is a byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.known = Pieces()
        self.stops = dict(zip(".,", self.whole([".", ","])))

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def learn(self, names: list[str]) -> None:
        """Encode pieces, many in one text, cut again where their bytes end.

        A full stop or comma after a letter or digit is a token of its own, so such a piece is put
        together from the piece without it.
        """
        known = self.known
        stopped = [n for n in names if n[-1:] in (".", ",") and n[-2:-1].isalnum()]
        pieces = set(names).difference(stopped)
        pieces.update(n for n in (s[:-1] for s in stopped) if not known.holds(n))
        odd = [n for n in pieces if n[:1] == ALONE or not n or n[0].isspace() or n[-1].isspace()]
        pieces.difference_update(odd)
        known.update(zip(odd, self.whole([n[1:] if n[:1] == ALONE else f" {n}" for n in odd])))
        plain = list(pieces)
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        found = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
        width = self.kind.itemsize
        for group, encoding in zip(groups, found):
            ids = np.array(encoding.ids, self.kind)
            ends = np.cumsum([len(p.encode("utf-8")) + 1 for p in group])
            reached = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[cuts - 1], ends):
                known.update(zip(group, self.whole([f" {p}" for p in group])))
                continue
            raw, places = ids.tobytes(), [0, *(cuts * width).tolist()]
            known.update(zip(group, [raw[a:b] for a, b in zip(places, places[1:])]))
        for name in stopped:
            known[name] = known[name[:-1]] + self.stops[name[-1]]

    def pieces(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, list[int], dict[str, bytes]]:
        """Names of all pieces of the texts, how many each text has, in which order the texts stand, and the
        ids of the texts that are not cut."""
        simple, order, others, sizes, whole = [], [], [], [], []
        for i, text in enumerate(texts):
            if not text:
                others.append((i, []))
            elif any(c in text for c in ODD):
                others.append((i, [f"{ALONE}{ALONE}{text}"]))
                whole.append(text)
            elif any(r in text for r in RUNS):
                others.append((i, [f"{ALONE}{p}" for p in PLAIN.findall(text)]))
            else:
                order.append(i)
                if "\n" in text and text[-1] != "\n" and text[0] != "\n" and not any(r in text for r in INNER):
                    text = text.replace("\n", f" {ALONE}\n {ALONE}")
                simple.append(f"{ALONE}{text}")
        cut = pc.split_pattern(pa.array(simple, pa.large_string()), " ")
        names = [cut.flatten(), pa.array([p for _, parts in others for p in parts], pa.large_string())]
        sizes = np.concatenate([np.diff(cut.offsets.to_numpy()), np.array([len(parts) for _, parts in others], np.int64)])
        whole_ids = dict(zip((f"{ALONE}{ALONE}{t}" for t in whole), self.whole(whole)))
        return pa.concat_arrays(names), sizes.astype(np.int64), order + [i for i, _ in others], whole_ids

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by `end` if there is one, and their sizes.

        Pieces are told apart once for all texts; ids are looked up for the distinct ones only.
        """
        names, counts, order, whole = self.pieces(texts)
        coded = names.dictionary_encode()
        distinct, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self.known.make_room()
        known, older = self.known, self.known.older
        self.learn([n for n in distinct if n not in known and n not in older and n not in whole])
        raw = [whole[n] if n in whole else self.known[n] for n in distinct] if whole else list(map(self.known.__getitem__, distinct))
        ids = np.frombuffer(b"".join(raw), self.kind)
        lengths = np.fromiter(map(len, raw), np.int32, len(raw)) // self.kind.itemsize
        each = lengths[index]
        total = int(each.sum(dtype=np.int64))
        small = np.int32 if total + len(ids) < 1 << 31 else np.int64
        begins = (np.cumsum(lengths, dtype=small) - lengths)[index]
        stops = np.cumsum(each, dtype=small)
        flat = ids[np.repeat(begins - stops + each, each) + np.arange(total, dtype=small)]
        ends = np.concatenate(([0], stops)).astype(np.int64)[np.cumsum(counts)]
        sizes = np.diff(ends, prepend=0)
        if order != list(range(len(order))):
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            spans = list(zip((ends - sizes).tolist(), ends.tolist()))
            flat = np.concatenate([flat[:0], *[flat[slice(*spans[p])] for p in place]])
            sizes = sizes[place]
        if end is None:
            return flat, sizes
        closed = np.full(len(flat) + len(sizes), end, self.kind)
        inner = np.ones(len(closed), bool)
        inner[np.cumsum(sizes + 1) - 1] = False
        closed[inner] = flat
        return closed, sizes + 1


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker, which keeps it for later tasks."""
    return Encoder(path)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids): documents in ascending doc_id, cut into parts in that order.

    `start` counts within the part. The last row of a part has no tokens; it holds the part's `counts` of ids. Rows without doc_id come first; rows with the same one are ordered
    by a hash of their text, so that a very common id is cut as well.
    """
    schema = "part int, doc_id bigint, start bigint, n_tokens bigint, ids binary, counts binary"
    tie = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", "text", tie.alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )

    def rows(part: int, docs: pa.Array, starts: np.ndarray, sizes: np.ndarray, ids: pa.Array, counts: list) -> pa.RecordBatch:
        columns = [
            pa.array(np.full(len(ids), part, np.int32)),
            docs.cast(pa.int64()),
            pa.array(starts, pa.int64()),
            pa.array(sizes, pa.int64()),
            ids,
            pa.array(counts, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = encoder(path), TaskContext.get().partitionId(), 0
        counts = np.zeros(coder.size, np.int64)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            ids, sizes = coder.encode(batch.column("text").to_pylist(), END_ID)
            stops = at + np.cumsum(sizes)
            counts += np.bincount(ids, minlength=coder.size)
            ends = np.concatenate(([0], np.cumsum(sizes))) * coder.kind.itemsize
            held = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield rows(part, batch.column("doc_id"), stops - sizes, sizes, held.cast(pa.binary()), [None] * len(sizes))
            at = int(stops[-1])
        yield rows(part, pa.nulls(1, pa.int64()), np.array([at]), np.array([0]), pa.array([b""], pa.binary()), [counts.tobytes()])

    return ordered.mapInArrow(run, schema)


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                found = np.frombuffer(counts, np.int64)
                total = found.copy() if total is None else total + found
        if total is not None:
            ids = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    held = tokens.where("counts IS NOT NULL").select("counts")
    summed = held.mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = summed.toPandas()  # one row per id of the vocabulary at most
    counts = np.zeros(max(rows.id.max() + 1, END_ID + 1) if len(rows) else END_ID + 1, np.int64)
    counts[rows.id.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return counts


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for ids that do not occur."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    leaves, merged = [], weights
    leaf = np.ones(len(weights), bool)
    for _ in range(limit - 1):
        leaves.append(leaf)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        merged, leaf = both[order], order < len(weights)
    leaves.append(leaf)
    take, result = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        result[:own] += 1
        take = 2 * (take - own)
    lengths[used] = result
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id): the lengths alone give the code book."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.nonzero(lengths)[0]
    order = used[np.argsort(lengths[used], kind="stable")]
    code, before = 0, 0
    for size, n in zip(*np.unique(lengths[order], return_counts=True)):
        ids = order[lengths[order] == size]
        code <<= int(size) - before
        codes[ids] = code + np.arange(n)
        code, before = code + int(n), int(size)
    return codes


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of a block, and the bit offset of every `EVERY`-th id."""
    small = np.int32 if len(ids) < 1 << 26 else np.int64  # bits of a block, at most LIMIT an id
    sizes = lengths.astype(small)[ids]
    ends = np.cumsum(sizes, dtype=small)
    starts = ends - sizes
    total = int(ends[-1])
    word = starts >> 5
    leading = codes.astype(np.uint64) << (64 - lengths).astype(np.uint64)
    wide = leading[ids] >> (starts & 31).astype(np.uint64)
    first = np.concatenate(([0], np.nonzero(np.diff(word))[0] + 1))  # a code begins in every 32-bit word
    packed = np.zeros(len(first) + 1, np.uint64)  # bits are disjoint: sums are unions
    packed[:-1] += np.add.reduceat(wide >> np.uint64(32), first)
    packed[1:] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
    return packed.astype(">u4").tobytes()[: (total + 7) // 8], starts[::EVERY]


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """For every LIMIT bits: the id whose code they begin with, times 32, plus its length."""
    table = np.zeros(1 << LIMIT, np.int32)
    codes = canonical_codes(lengths)
    used = np.nonzero(lengths)[0]
    order = used[np.lexsort((codes[used], lengths[used]))]
    spans = 1 << (LIMIT - lengths[order])
    table[: int(spans.sum())] = np.repeat(order * 32 + lengths[order], spans)
    return table


def decode_ids(payload: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The ids of a block; all stretches between checkpoints are decoded side by side."""
    small = np.int32 if len(payload) < 1 << 27 else np.int64
    raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.int32)
    words = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at, last = checkpoints.astype(small), len(words) - 1
    out = np.empty((EVERY, len(at)), np.int32)
    for k in range(EVERY):
        entry = table[(words[np.minimum(at >> 3, last)] >> (8 - (at & 7))) & 0xFFFF]
        out[k] = entry >> 5
        at = at + (entry & 31)
    return out.T.reshape(-1)[:n]


BLOCKS = (
    "part int, start bigint, n_ids bigint, doc_ids array<bigint>, sizes array<bigint>, checkpoints binary, payload binary"
)


def blocks_of(tokens: DataFrame, lengths: np.ndarray, path: str) -> DataFrame:
    """Blocks of whole documents, each decodable alone."""
    codes = canonical_codes(lengths)
    fields = ["part", "start", "n_ids", "doc_ids", "sizes", "checkpoints", "payload"]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        part, _, start, _, _ = rows[0]
        ids = np.frombuffer(b"".join(r[4] for r in rows), encoder(path).kind)
        payload, checkpoints = encode_ids(ids, lengths, codes)
        values = [part, start, len(ids), [r[1] for r in rows], [r[3] for r in rows], checkpoints.astype("<u4").tobytes(), payload]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, expected = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and (held >= BLOCK_IDS or (row[0], row[2]) != expected):
                    yield block(rows)
                    rows, held = [], 0
                rows.append(row)
                held += row[3]
                expected = (row[0], row[2] + row[3])
        if rows:
            yield block(rows)

    return tokens.mapInArrow(run, BLOCKS)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Write `docs` (doc_id, text) as token files: `folder`/blocks, /parts and /codebook.

    Every whole text is encoded and ends with END_ID; null and empty texts are that id alone. Documents
    stand in ascending doc_id (null first). Codes come from the counts of all ids. A block holds whole
    documents, a bit offset for every EVERY-th id, and the Huffman bits. An empty table gives no blocks.
    """
    path = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    work = scratch_path(spark)
    tokenized(docs, path).write.option("compression", "zstd").parquet(work)
    tokens = spark.read.parquet(work)
    lengths = code_lengths(id_counts(tokens))
    texts = tokens.where("counts IS NULL").drop("counts")
    blocks_of(texts, lengths, path).write.option("compression", "none").parquet(f"{folder}/blocks")
    ends = tokens.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    offsets = ends.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))
    offsets.write.parquet(f"{folder}/parts")
    book = [(int(i), int(lengths[i])) for i in np.nonzero(lengths)[0]]
    spark.createDataFrame(book, "id int, length int").coalesce(1).write.parquet(f"{folder}/codebook")


def read_blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks with the offset of their part, and the code lengths."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    parts = spark.read.schema("part int, offset bigint").parquet(f"{folder}/parts")
    book = spark.read.schema("id int, length int").parquet(f"{folder}/codebook").toPandas()
    lengths = np.zeros(max(book.id.max() + 1 if len(book) else 0, END_ID + 1), np.int64)
    lengths[book.id.to_numpy(np.int64)] = book.length.to_numpy(np.int64)
    return blocks.join(parts, "part"), lengths


def read_documents(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) decoded from the files; ids only if asked for."""
    blocks, lengths = read_blocks(spark, folder)
    table = decoding_table(lengths)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, start, n, marks, payload in zip(*[c.to_pylist() for c in batch.columns]):
                ids = decode_ids(payload, np.frombuffer(marks, "<u4"), n, table).astype("<u4")
                ends = np.cumsum(sizes)
                cuts = list(zip([0, *ends.tolist()], ends.tolist()))
                columns = [
                    pa.array(docs, pa.int64()),
                    pa.array(start + ends - np.array(sizes)),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in cuts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in cuts], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    first = (F.col("start") + F.col("offset")).alias("start")
    return blocks.select("doc_ids", "sizes", first, "n_ids", "checkpoints", "payload").mapInArrow(run, schema)
