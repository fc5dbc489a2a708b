"""Token counts of documents under a unigram vocabulary, with scores shared along a trie."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporia.llm.common import fresh, keeps_own_columns

MARK = "▁"  # stands for the space before a word in the vocabulary
BYTE_PENALTY = 16.0  # log probability lost by every byte of a character that no piece covers; more than by any piece
CACHED_WORDS = 400_000
SLICE = 1024  # texts whose words are held at once
ADDED = ("n_words", "n_tokens", "n_bytes")


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with log probabilities by Zipf's law from their rank; they add up to 1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    ids = [i for i in range(model.get_piece_size()) if not any(kind(i) for kind in kinds)]
    total = math.fsum(1 / (rank + 2) for rank in range(len(ids)))
    return {model.id_to_piece(i): -math.log((rank + 2) * total) for rank, i in enumerate(ids)}


class TrieCounts:
    """Counts of the best segmentations of pre-tokens.

    New pre-tokens are walked in sorted order, which is a walk of their trie: the branch to the current
    node is a stack of forward scores, and a pre-token only adds the nodes beyond the prefix it shares with
    the one before. So a shared prefix is scored once. The score of a node is the best over the
    pieces that end there, and at the end of a pre-token the counts are stored.
    """

    def __init__(self, vocabulary: dict[str, float]):
        self.vocabulary = vocabulary
        self.longest: dict[str, int] = {}  # length of the longest piece that ends in a character
        for piece in vocabulary:
            self.longest[piece[-1]] = max(len(piece), self.longest.get(piece[-1], 0))
        self.known: dict[bytes, int] = {}
        self.covered: dict[bytes, int] = {}  # of the words that need them: bytes outside all pieces

    def learn(self, words: Iterable[bytes]) -> None:
        get, longest = self.vocabulary.get, self.longest
        scores, tokens, loose, before = [0.0], [0], [0], ""
        for text, word in sorted((MARK + w.decode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for a, b in zip(text, before):
                if a != b:
                    break
                shared += 1
            del scores[shared + 1 :], tokens[shared + 1 :], loose[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                last = text[end - 1]
                size = len(last.encode("utf-8", "surrogatepass"))
                best = scores[-1] - BYTE_PENALTY * size
                n, raw = tokens[-1] + size, loose[-1] + size
                for start in range(max(0, end - longest.get(last, 0)), end):
                    piece = get(text[start:end])
                    if piece is not None:
                        score = scores[start] + piece
                        if score > best or score == best and tokens[start] + 1 < n:
                            best, n, raw = score, tokens[start] + 1, loose[start]
                scores.append(best)
                tokens.append(n)
                loose.append(raw)
            before = text
            self.known[word] = tokens[-1]
            if loose[-1]:
                self.covered[word] = loose[-1]

    def count(self, texts: Iterable[str | None]) -> list[tuple[int, int, int]]:
        """Words, tokens and byte tokens of each text."""
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
            self.covered.clear()
        self.learn(set().union(*split).difference(self.known))
        known, loose = self.known, self.covered
        return [(len(s), sum(map(known.__getitem__, s)), sum(map(loose.get, s, [0] * len(s)))) for s in split]


@functools.cache
def counter(path: str) -> TrieCounts:
    """One per Python worker, which keeps it for later tasks."""
    return TrieCounts(read_vocabulary(path))


@keeps_own_columns
def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of `docs` with n_words, n_tokens and n_bytes (tokens that are bytes of uncovered characters).

    A word, cut at ASCII white space and marked, is segmented into the pieces of highest total log
    probability; ties go to fewer tokens. Nothing is shuffled: each task shares prefixes among the distinct
    words of its batches and remembers their counts. A null or blank text has zeros; repeated rows are counted
    alike; columns named like the added ones are replaced; an empty table gives an empty result.
    """
    file = path or vocabulary_path()

    @F.pandas_udf("struct<n_words:bigint,n_tokens:bigint,n_bytes:bigint>")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            trie, rows = counter(file), []
            for i in range(0, len(texts), SLICE):
                rows += trie.count(texts[i : i + SLICE])
            yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, 3), columns=["n_words", "n_tokens", "n_bytes"])

    return fresh(docs, *ADDED).withColumn("_counts", counts("text")).select(
        *fresh(docs, *ADDED).columns, "_counts.n_words", "_counts.n_tokens", "_counts.n_bytes"
    )
