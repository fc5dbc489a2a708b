"""Toxicity: a linear classifier that is held still under swapped identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporia.llm.common import fresh, keeps_own_columns
from emporia.sources.store import work_table

SAMPLE_ROWS = 16_000  # labelled rows that the classifier is fitted on, at most
LEAST_ROWS = 3  # labelled texts a feature must be in
LEAST_GAIN = 15.0  # twice the log-likelihood gained by a feature alone
PENALTY = 4.0  # weight of squared score changes under swaps
RIDGE = 0.3  # prior strength of the weights, in rows
STEPS = 300
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
ADDED = ("score", "predicted")
WORD = re.compile(r"\w+")

# Identity terms by kind; a term is swapped for the next of its kind. A parameter, not a word list of the model.
IDENTITIES = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("mother", "father"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("american", "mexican", "african", "european", "chinese", "indian", "russian"),
    ("immigrants", "citizens", "refugees"), ("young", "old"), ("blind", "deaf", "disabled"),
    ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
    ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"), ("musulmanes", "cristianos", "judíos"),
)


class Model(NamedTuple):
    weights: dict[str, float]
    intercept: float


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def parts(word: str) -> list[str]:
    """Features of a word: itself, its beginnings and its ends."""
    found = [f"={word}"]
    for n in PREFIXES:
        if len(word) > n:
            found += [f"<{word[:n]}", f">{word[-n:]}"]
        elif len(word) == n:
            found += [f"<{word}", f">{word}"]
    return found


def features(words: set[str]) -> set[str]:
    return {p for w in words for p in parts(w)}


def swaps(identities: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    return {term: kind[(i + 1) % len(kind)] for kind in identities for i, term in enumerate(kind)}


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(toxic, text) of labelled documents, at most `rows` of them, chosen by a hash of the id.

    Labels that are null or not 0 or 1 do not count; of several labels of one document the highest does.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows)
    # At most `rows` short rows are broadcast, so the texts are not shuffled.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def telling_features(sample: DataFrame, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> list[str]:
    """All features whose presence tells the classes apart by a likelihood-ratio test.

    They are as many as the sample holds, and so bounded by its rows.
    """

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features(words_in(t))))

    totals = sample.agg(F.count("*"), F.sum("toxic")).first()
    rows, toxic = totals[0], totals[1] or 0
    if not 0 < toxic < rows:
        return []
    counted = (
        sample.select("toxic", F.explode(found("text")).alias("feature"))
        .groupBy("feature")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
        .where(F.col("n") >= LEAST_ROWS)
    )

    def likelihood(k, n):
        return F.when((k > 0) & (k < n), k * F.log(k / n) + (n - k) * F.log(1 - k / n)).otherwise(0.0)

    n, k, all_n, all_k = F.col("n"), F.col("k"), F.lit(float(rows)), F.lit(float(toxic))
    gain = 2 * (likelihood(k, n) + likelihood(all_k - k, all_n - n) - likelihood(all_k, all_n))
    best = counted.withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
    return [r[0] for r in best.orderBy(F.desc("gain"), "feature").select("feature").collect()]


def examples(sample: DataFrame, names: list[str], identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> pd.DataFrame:
    """Label, feature numbers, and feature numbers after the swap of every labelled text."""
    index = {f: i for i, f in enumerate(names)}
    swap = swaps(identities)

    def numbers(words: set[str]) -> list[int]:
        return sorted({index[p] for w in words for p in parts(w) if p in index})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [words_in(t) for t in batch.text]
            swapped = [{swap.get(w, w) for w in s} for s in sets]
            yield pd.DataFrame(
                {"toxic": batch.toxic, "own": map(numbers, sets), "other": map(numbers, swapped)}
            )

    return sample.mapInPandas(run, "toxic int, own array<int>, other array<int>").toPandas()


def fit_rows(rows: pd.DataFrame, n_features: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Logistic loss + penalty * (change of the score under the swap)² + ridge, by Adam steps."""

    def sparse(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        sizes = lists.map(len).to_numpy(np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(lists)), sizes), flat

    n = len(rows)
    y = rows.toxic.to_numpy(float)
    row, col = sparse(rows.own)
    changed = rows[[list(a) != list(b) for a, b in zip(rows.own, rows.other)]]
    c_row, c_col = sparse(changed.own)
    d_row, d_col = sparse(changed.other)
    w, b = np.zeros(n_features), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[col], n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(col, error[row], n_features) / n + RIDGE / n * w
        if len(changed):
            change = np.bincount(c_row, w[c_col], len(changed)) - np.bincount(d_row, w[d_col], len(changed))
            pull = np.bincount(c_col, change[c_row], n_features) - np.bincount(d_col, change[d_row], n_features)
            grad += 2 * penalty * pull / len(changed)
        g = np.append(grad, error.mean())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = SAMPLE_ROWS,
    identities: tuple[tuple[str, ...], ...] = IDENTITIES,
    penalty: float = PENALTY,
) -> Model:
    """Fit on `labels` (doc_id, toxic) of `docs`; without both classes the model scores everything low."""
    sample = work_table(labelled_sample(docs, labels, rows))
    names = telling_features(sample, identities)
    if not names:
        return Model({}, -4.0)
    weights, intercept = fit_rows(examples(sample, names, identities), len(names), penalty)
    return Model({f: float(w) for f, w in zip(names, weights) if abs(w) > 1e-6}, float(intercept))


@keeps_own_columns
def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` with `score`, between 0 and 1, and `predicted`, 1 from the threshold on.

    Only the text is looked at, and all of it. Null and empty texts have the score of no evidence.
    Columns named like the added ones are replaced; repeated rows are scored alike; an empty table gives an empty
    result.
    """
    weights, intercept = model

    class Evidence(dict):
        """The model's features of a word, for words seen before; bounded."""

        def __missing__(self, word: str) -> tuple[str, ...]:
            if len(self) >= 300_000:
                self.clear()
            self[word] = found = tuple(p for p in parts(word) if p in weights)
            return found

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        evidence = Evidence()
        for texts in batches:
            sums = np.empty(len(texts))
            for i, text in enumerate(texts):
                found = set().union(*map(evidence.__getitem__, WORD.findall(text.lower()))) if text else ()
                sums[i] = intercept + sum(sorted(weights[f] for f in found))
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -500, 500))))

    return (
        fresh(docs, *ADDED)
        .withColumn("score", score("text"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
