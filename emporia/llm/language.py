"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporia.llm.common import fresh, unused
from emporia.sources.store import work_table

GRAMS = (1, 2, 3, 4)  # code points of an n-gram
BITS = 16  # n-grams are hashed to 2^BITS features
SAMPLE_ROWS = 4_000  # labelled rows that the classifier is fitted on, at most; the same number of every language
CALIBRATION = 5  # one in so many sampled rows sets the temperature instead
EPOCHS = 6
ALPHA, BETA = 0.5, 1.0  # learning rates of follow-the-regularised-leader
L1, L2 = 0.02, 0.05  # the elastic net
SCALE = 16.0  # of TF-IDF values; shares of a text's n-grams are small numbers
MINIBATCH = 32  # texts whose gradients are added up at once
LEAST_TEXTS = 2  # sampled texts that a feature must be in
BLOCK = 1 << 20  # code points looked at at once
UNKNOWN = "und"
ADDED = ("lang_pred", "score")

WORDLIKE = re.compile(r"[^\W\d_]")
GAPS = re.compile(r"[\W\d_]+")


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # 2^BITS rows, a column per language; TF-IDF weights are multiplied in
    intercept: np.ndarray
    temperature: float


def has_letter(text: str | None) -> bool:
    """Whether any code point is a letter (general category L)."""
    return bool(text) and any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def hashed_grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of a text, in blocks: lower case, runs of non-letters being one space.

    Blocks overlap by what n-grams need, so that every n-gram is given once.
    """
    points = np.frombuffer(f" {GAPS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    points = points.astype(np.uint32)
    for at in range(0, len(points), BLOCK):
        part = points[at : at + BLOCK + max(GRAMS) - 1]
        mixed = np.zeros(len(part), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            # Polynomial hash of the n code points from here on, modulo 2^32.
            usable = len(part) - n + 1
            if usable <= 0:
                break
            mixed = mixed[:usable] * np.uint32(0x01000193) + part[n - 1 : n - 1 + usable] + np.uint32(1)
            if n in GRAMS:
                own = mixed[:BLOCK]
                spread = (own ^ (own >> np.uint32(15))) * np.uint32(0x9E3779B1)
                yield spread >> np.uint32(32 - BITS)


def term_frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their shares of its n-grams."""
    counts = np.zeros(1 << BITS, np.int64)
    for grams in hashed_grams(text):
        counts += np.bincount(grams, minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found.astype(np.uint32), (counts[found] / counts.sum()).astype(np.float32)


def sample(docs: DataFrame, learnable, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, place, text): at most `rows` rows of `docs` that `learnable` allows, spread evenly over languages.

    Rows are chosen and placed by a hash of id and text; every language keeps one row at least. Only
    keys are ranked, and Spark trims the ranking before it shuffles.
    """
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(13)).alias("place"))
    languages = known.agg(F.count_distinct("lang")).first()[0]
    most = max(1, rows // max(languages, 1))
    by_place = Window.partitionBy("lang").orderBy("place")
    chosen = known.select("lang", "place").withColumn("at", F.row_number().over(by_place)).where(F.col("at") <= most)
    chosen = work_table(chosen.select("lang", "place").distinct())
    # At most `rows` short rows are broadcast, so the texts are not shuffled; copies with one id count once.
    return known.join(F.broadcast(chosen), ["lang", "place"]).dropDuplicates(["lang", "place"])


class Rows(NamedTuple):
    """Sparse rows: features and values of row r stand from indptr[r] to indptr[r + 1]."""

    label: np.ndarray
    indptr: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def pick(self, chosen: np.ndarray) -> Rows:
        spans = [slice(self.indptr[r], self.indptr[r + 1]) for r in chosen]
        sizes = [s.stop - s.start for s in spans]
        feature = np.concatenate([self.feature[:0], *[self.feature[s] for s in spans]])
        value = np.concatenate([self.value[:0], *[self.value[s] for s in spans]])
        return Rows(self.label[chosen], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), feature, value)

    def logits(self, weights: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(self.label), weights.shape[1]))
        for r in range(len(self.label)):
            a, b = self.indptr[r], self.indptr[r + 1]
            sums[r] = self.value[a:b] @ weights[self.feature[a:b]]
        return sums + intercept


def collect_rows(sampled: DataFrame) -> tuple[list[str], np.ndarray, Rows]:
    """Languages in code-point order, places and sparse rows of the sample, made in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_frequencies(t) if has_letter(t) else None for t in batch.column("text").to_pylist()]
            kept = pa.array([f is not None for f in found])
            found = [f for f in found if f is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").filter(kept), batch.column("place").filter(kept),
                    pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()),
                ],
                names=["lang", "place", "features", "shares"],
            )

    table = sampled.mapInArrow(run, "lang string, place bigint, features binary, shares binary").toPandas()
    table = table.sort_values(["place", "lang"], ignore_index=True)  # the same order in every run
    languages = sorted(set(table.lang))
    label = table.lang.map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    sizes = [len(f) // 4 for f in table.features]
    rows = Rows(
        label,
        np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
        np.frombuffer(b"".join(table.features), np.uint32).astype(np.int64),
        np.frombuffer(b"".join(table.shares), np.float32).astype(np.float64),
    )
    return languages, table.place.to_numpy(np.int64), rows


def inverse_frequencies(rows: Rows, chosen: np.ndarray) -> np.ndarray:
    """ln((1 + texts) / (1 + texts with the feature)) + 1; 0 for features of too few texts."""
    texts = np.zeros(1 << BITS)
    for r in chosen:
        texts[rows.feature[rows.indptr[r] : rows.indptr[r + 1]]] += 1
    return np.where(texts >= LEAST_TEXTS, np.log((1 + len(chosen)) / (1 + texts)) + 1, 0.0)


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: Rows, chosen: np.ndarray, idf: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercept by FTRL-proximal with elastic net, over `chosen` rows in their order.

    z and n are the sums of gradients and squared gradients per feature and class; a weight is nonzero only where
    |z| exceeds L1. Gradients are added up over MINIBATCH rows.
    """
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    z0, n0 = np.zeros(classes), np.zeros(classes)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def update(z, n, w, g):
        total = n + g * g
        return z + g - (np.sqrt(total) - np.sqrt(n)) / ALPHA * w, total

    for _ in range(EPOCHS):
        for at in range(0, len(chosen), MINIBATCH):
            batch = rows.pick(chosen[at : at + MINIBATCH])
            size = len(batch.label)
            own = np.repeat(np.arange(size), np.diff(batch.indptr))
            value = batch.value * idf[batch.feature] * SCALE
            used, place = np.unique(batch.feature, return_inverse=True)
            w, w0 = weights(z[used], n[used], L1), weights(z0, n0, 0.0)
            logits = np.stack([np.bincount(own, value * w[place, c], size) for c in range(classes)], 1) + w0
            error = softmax(logits)
            error[np.arange(size), batch.label] -= 1
            error /= size
            gradient = np.stack([np.bincount(place, value * error[own, c], len(used)) for c in range(classes)], 1)
            z[used], n[used] = update(z[used], n[used], w, gradient)
            z0, n0 = update(z0, n0, w0, error.sum(axis=0))
    return weights(z, n, L1) * (idf * SCALE)[:, None], weights(z0, n0, 0.0)


def temperature_of(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss on rows that the weights have not seen, by golden section."""
    if not len(label):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(label)), label], 1e-300)).mean()) + 1e-4 * log_t * log_t

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, learnable=None, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on `docs` (doc_id, text, lang), on rows that the condition `learnable` allows.

    Without any labelled text with a letter there are no languages. Labels are values of `lang` as they
    are, the empty string included.
    """
    allowed = F.lit(True) if learnable is None else learnable
    languages, place, found = collect_rows(sample(docs, allowed, rows))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    aside = place % CALIBRATION == 0
    learned, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    if not len(learned):
        learned, held = held, learned
    idf = inverse_frequencies(found, learned)
    weights, intercept = follow_the_leader(found, learned, idf, len(languages))
    rest = found.pick(held)
    temperature = temperature_of(rest.logits(weights, intercept), rest.label)
    return Model(languages, weights.astype(np.float32), intercept, temperature)


def probabilities(text: str, model: Model) -> np.ndarray:
    """Calibrated probability of each language; looks at all n-grams of the whole text."""
    sums, total = np.zeros(len(model.languages)), 0
    for grams in hashed_grams(text):
        sums += np.add.reduce(model.weights.take(grams, axis=0), axis=0, dtype=np.float64)
        total += len(grams)
    return softmax((sums / max(total, 1) + model.intercept) / model.temperature)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of `docs` with `lang_pred` and `score`, the probability of that language.

    Only the text is looked at, and all of it. Null texts and those without a letter are `und` with score 0,
    as is every text if no language was learned. Ties go to the first language by code point.
    Repeated rows stay; columns named like the added ones are replaced; an empty table stays empty.
    """
    languages = model.languages

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = []
            for text in texts:
                if languages and has_letter(text):
                    p = probabilities(text, model)
                    found.append((languages[int(p.argmax())], float(p.max())))
                else:
                    found.append((UNKNOWN, 0.0))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    rows = fresh(docs, *ADDED)
    free = unused(rows, "found")
    return rows.withColumn(free, predict("text")).select(*rows.columns, f"{free}.lang_pred", f"{free}.score")
