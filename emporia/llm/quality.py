"""Quality rules as a short-circuit cascade, in the order of rejections per cost."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emporia.llm.common import fresh, keeps_own_columns, words_of
from emporia.sources.store import work_table

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^ \t-\r]"
SAMPLE_ROWS = 2000  # expected rows of the sample on which rules are timed
REPEATS = (4, 32)  # times that the sample is gone through to time a rule
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "kept")


class Rule(NamedTuple):
    """A named test that is true for a text to be rejected."""

    name: str
    fails: Column


class Measured(NamedTuple):
    rule: Rule
    rejected: float  # part of the sample
    seconds: float  # per row, without what a job costs by itself


def default_rules() -> list[Rule]:
    """Rules over `text` and the base figures, with thresholds in use for web text."""
    words, text = F.col("n_words"), F.coalesce(F.col("text"), F.lit(""))
    lines = F.size(F.split(text, "\n"))
    lettered = F.size(F.filter(words_of(text), lambda w: w.rlike(r"\p{L}")))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 20 * words),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * lines),
        Rule("word_length", ~F.col("word_chars").between(2 * words, 20 * words)),
        Rule("ellipses", 10 * F.regexp_count(text, F.lit(r"(?:\.\.\.|…)[ \t]*(?:\n|$)")) > 3 * lines),
        Rule("bullets", 10 * F.regexp_count(text, F.lit(r"(?m)^[ \t]*[-•]")) > 9 * lines),
        Rule("letters", 10 * lettered < 7 * words),
        Rule("few_words", 100 * F.size(F.array_distinct(words_of(text))) < 5 * words),
    ]


def base_figures(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of `text`.

    Words in repeated three-word windows: the windows' hashes are compared as plain longs, which
    settles texts without a repeat; else (hash, place) pairs are sorted, equal neighbours mark the
    places of repeated windows, and each place covers the words up to the next one, three at most.
    Everything stays in the row, so nothing is shuffled. A null or blank text has only zeros.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumn("_words", words_of(text))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(HAS_WORD))

    def window(word: Column, i: Column) -> Column:
        return F.xxhash64(word, F.get("_words", i + 1), F.get("_words", i + 2))

    hashed = split.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "_lines": lines,
            "_windows": F.slice(F.transform("_words", window), F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
        }
    ).drop("_words")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    paired = hashed.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_pairs": F.when(repeats, pairs),
        }
    ).drop("_lines", "_windows")

    def place(pair: Column, k: Column) -> Column:
        same = pair["h"].eqNullSafe(F.get("_pairs", k - 1)["h"]) | pair["h"].eqNullSafe(F.get("_pairs", k + 1)["h"])
        return F.when(same, pair["i"])

    placed = paired.withColumn("_places", F.sort_array(F.array_compact(F.transform("_pairs", place)))).drop("_pairs")

    def covered(at: Column, k: Column) -> Column:
        return F.least(F.coalesce(F.get("_places", k + 1) - at, F.lit(3)), F.lit(3)).cast("long")

    words = F.aggregate(F.transform("_places", covered), F.lit(0).cast("long"), lambda a, b: a + b)
    whole = placed.withColumn("n_repeat_words", F.coalesce(words, F.lit(0).cast("long"))).drop("_places")
    # Filters on the figures do not cross a generator; pushed below, they would compute everything again
    # for each array element.
    return whole.select(*[c for c in whole.columns if c not in BASE], F.inline(F.array(F.struct(*BASE))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measure(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[Measured]:
    """Cost and selectivity of each rule on a sample of the rows that pass the base tests.

    A rule is tried on the sample repeated until its job takes four times as long as one that tests nothing
    (or REPEATS ends), and that one's time is taken off, so costs are those of the rule, not of starting a job.
    """
    total = docs.count()
    sample = docs.sample(min(1.0, sample_rows / total), seed) if total else docs
    rows = work_table(base_figures(sample.select("text")).where(~base_failed()))
    seen = max(rows.count(), 1)
    nothing = F.col("n_words") < 0

    def run(test: Column, repeats: int) -> tuple[float, int]:
        again = rows.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        began = time.perf_counter()
        hits = again.agg(F.count_if(test)).first()[0]
        return time.perf_counter() - began, hits

    run(nothing, 1)  # starts workers and compiles code
    idle = {n: min(run(nothing, n)[0] for _ in range(2)) for n in REPEATS}
    found = []
    for rule in rules:
        for repeats in REPEATS:
            (first, hits), (second, _) = run(rule.fails, repeats), run(rule.fails, repeats)
            net = min(first, second) - idle[repeats]
            if net > 3 * idle[repeats]:
                break
        # What a job's own time hides counts as a tenth of that time.
        cost = max(net, idle[repeats] / 10) / (seen * repeats)
        found.append(Measured(rule, hits / repeats / seen, cost))
    return found


def cascade(measured: list[Measured]) -> list[Measured]:
    """The order of evaluation: most rejections per second first."""
    return sorted(measured, key=lambda m: (-m.rejected / max(m.seconds, 1e-9), m.seconds))


def verdict(order: list[Measured]) -> Column:
    """True if no rule fails; the branches are tried in order and the first failure ends the row."""
    kept = F.lit(True)
    for m in reversed(order):
        kept = F.when(F.coalesce(m.rule.fails, F.lit(False)), False).otherwise(kept)
    return kept


@keeps_own_columns
def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rows of `docs` with the base figures, `base_failed` and `kept`.

    Every row is judged on its whole text. Only the order of the rules comes from the sample, so the
    result is the same for any sample. A null text is empty and fails. Repeated rows are judged alike;
    columns named like the added ones are replaced; an empty table gives an empty result.
    """
    rows = fresh(docs, *ADDED)
    order = cascade(measure(rows, rules or default_rules()))
    kept = F.when(base_failed(), False).otherwise(verdict(order))
    return base_figures(rows).withColumns({"base_failed": base_failed(), "kept": kept})
