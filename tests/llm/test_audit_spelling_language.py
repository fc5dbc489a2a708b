"""Filter audit, spelling variants and language identification against plain versions, and on awkward rows."""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus import DOCS, documents, prose

from emporia.llm import filter_audit, language, spelling, term_matrix
from emporia.llm.queries import QUERIES

LABELS = "doc_id bigint, quality int, toxic int, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank, repeated and long texts, copies, and columns with inner names."""
    long = prose(1, 30_000)
    rows = [
        (1, "one two three", "en", "a", 1), (1, "one two three", "en", "a", 1), (1, "Another TEXT | here", "en", None, 1),
        (9, "one two three", "en", "", 1), (None, "no id here", "en", "b", 1), (None, None, None, None, None),
        (2, None, "en", "a", 0), (3, "", "en", "b", 0), (4, " \t\n ", "en", "b", 4), (5, long, "en", "a", 1),
        (6, long + " end", "en", "c", 1), (8, long, "en", "d", 1), (7, "çà  　 x\n\n y 12 Éa", "fr", "c", 1),
        (10, "x" * 5000 + " " + "x" * 4999 + " " + "x" * 5000 + " " + "x" * 4999, "en", "c", 1),
    ]
    inner = "part word n m key i width fails digest own term held_out found score lang_pred place at".split()
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("own") for n in inner})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 12 Filter interaction audit


def plain_fails(rows):
    """For (doc_id, text) pairs: the filters that each fails, told one by one."""
    result = []
    for doc_id, text in rows:
        text = text or ""
        words = [w for w in re.split(r"[ \t-\r]+", text) if w]
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * any(o is not None and doc_id is not None and o < doc_id and (t or "") == text for o, t in rows)
        result.append(fails)
    return result


def plain_audit(rows, labels):
    """All orders by walking every document through every order."""
    fails = plain_fails([(r[0], r[1]) for r in rows])
    found = Counter()
    for row, failed in zip(rows, fails):
        good = any(i is not None and i == row[0] and q == 1 for i, q, _, _ in labels)
        toxic = any(i is not None and i == row[0] and t == 1 for i, _, t, _ in labels)
        part = row[3] or ""
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                key = part, order, step
                if letter in failed and gone:
                    found[*key, "redundant"] += 1
                elif letter in failed:
                    gone = True
                    found[*key, "removed"] += 1
                    found[*key, "good_lost"] += good
                    found[*key, "toxic_lost"] += toxic
                    found[part, letter, "shapley"] += 1
                elif not gone:
                    found[*key, "kept"] += 1
                found[*key, "unique_fails"] += failed == letter
    return found


def check_audit(spark, docs, labels):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    expected = plain_audit(rows, labels)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    for r in got:
        key = r.part, r.filter_order, r.step
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == expected[*key, name], (key, name)
        assert r.shapley == expected[r.part, r.filter_order[r.step - 1], "shapley"]


def test_audit_on_awkward_rows(spark, odd):
    check_audit(spark, odd, [(1, 1, 0, "x"), (1, None, None, "x"), (8, 0, 1, "x"), (None, 1, 1, "x"), (5, 1, 1, None)])


def test_audit_of_copies_over_small_shards(spark, monkeypatch):
    draw = random.Random(4)
    texts = [draw.choice(["", "A b # c", prose(draw.randrange(5), 250, 100), prose(i, 260, 900)]) for i in range(60)]
    build = term_matrix.build
    monkeypatch.setattr(term_matrix, "build", lambda rows: build(rows, shard_words=500))
    check_audit(spark, documents(spark, texts, ("a", "b", "c")), [(i, i % 2, int(i % 3 == 0), "") for i in range(50)])


def test_audit_of_an_empty_table(spark, none):
    assert filter_audit.audit(none, spark.createDataFrame([], LABELS)).count() == 0


def test_matrix_holds_the_counts_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(term_matrix, "BUCKET_ENTRIES", 50)
    texts = [prose(i, 40 + i, 60) + " ça" * (i % 3) for i in range(40)] + [""]
    docs = documents(spark, texts).withColumn("part", F.col("source")).repartition(3)
    matrix = term_matrix.build(docs, shard_words=300)
    word = {r.term: r.word for r in matrix.dictionary.collect()}
    assert sorted(word) == list(range(matrix.size)) and len(set(word.values())) == matrix.size

    def entries(row, terms, counts):
        owner = np.repeat(np.array(row["doc_ids"]), row["row_terms"])
        columns = [pa.array(owner, pa.int64()), pa.array(terms, pa.int64()), pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "term", "n"])

    got = Counter()
    for r in matrix.map_shards(entries, "doc_id bigint, term bigint, n bigint").collect():
        got[r.doc_id, word[r.term]] += r.n
    assert got == Counter((i, w) for i, t in enumerate(texts) for w in t.split())


def test_packed_numbers_come_back():
    values = np.array([0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32)
    assert term_matrix.unpacked(term_matrix.packed(values), 6).tolist() == values.tolist()
    assert term_matrix.unpacked(term_matrix.packed(values[:0]), 0).tolist() == []


# 11 Spelling variants


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, n, len(near[w]), form[w], counts.get(form[w]), root))
    return rows


def found_variants(docs):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs).collect()}


def variant_texts(seed: int) -> list[str]:
    """Few letters and much repetition, so that words have many near words and chains of forms."""
    draw = random.Random(seed)
    bases = ["".join(draw.choice("abé") for _ in range(draw.randrange(7, 12))) for _ in range(30)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(120):
            word = draw.choice(bases[: draw.choice((2, 30))])
            while draw.random() < 0.25:
                i = draw.randrange(len(word))
                word = word[:i] + draw.choice(["", "a", "É", word[i] + "b"]) + word[i + 1 :]
            words.append(word)
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("batch", [10_000, 7])
def test_variants_equal_all_pairs(spark, batch):
    texts = variant_texts(batch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = found_variants(documents(spark, texts))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = plain_variants(plain_words(list(enumerate(texts))))
    assert got == expected
    assert sum(r[3] is not None for r in expected) > 20 and any(r[5] not in (r[0], r[3]) for r in expected)


def test_variants_of_words_of_any_length(spark):
    """Edits at every place of words up to hundreds of letters are found in exactly one block."""
    draw = random.Random(8)
    words = set()
    for size in (7, 8, 9, 12, 23, 24, 25, 40, 300):
        base = "".join(draw.choice("abcdefgh") for _ in range(size))
        words.add(base)
        for i in {0, 1, 2, 3, size // 2, size - 4, size - 3, size - 2, size - 1}:
            words |= {base[:i] + "z" + base[i + 1 :], base[:i] + "y" + base[i:], base[:i] + base[i + 1 :]}
        words.add(base + "x")
    words = sorted(w for w in words if len(w) >= 7)
    counts = {w: 2 + 40 * (i % 3 == 0) for i, w in enumerate(words)}
    near = spelling.neighbours(spark.createDataFrame(list(counts.items()), "word string, n bigint"))
    got = {(r.word, r.n, r.n_near) for r in near.collect()}
    assert got == {(w, n, sum(one_edit(w, o) for o in words)) for w, n in counts.items()}


def test_variants_on_awkward_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found_variants(odd) == plain_variants(plain_words(rows))
    assert found_variants(none) == set()


# 13 Language identification

ALPHABETS = {"aa": "abcde", "bb": "defgh", "çç": "çéàbd"}


def babble(draw: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(draw.choice(ALPHABETS[lang]) for _ in range(draw.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    draw = random.Random(3)
    langs = [draw.choice(sorted(ALPHABETS)) for _ in range(400)]
    rows = [(i, babble(draw, lang, draw.randrange(3, 60)), lang, "a", 0) for i, lang in enumerate(langs)]
    return spark.createDataFrame(rows, DOCS)


def test_language_of_unseen_rows(tongues):
    model = language.train(tongues, F.col("doc_id") % 3 != 1)
    assert model.languages == sorted(ALPHABETS) and model.temperature > 0
    assert 0 < (model.weights != 0).mean() < 0.5  # the elastic net leaves most features out
    rows = language.identified(tongues.where("doc_id % 3 = 1"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(1 / 3 - 1e-9 <= r.score <= 1 for r in rows)
    again = language.train(tongues.repartition(5), F.col("doc_id") % 3 != 1)
    assert np.array_equal(model.weights, again.weights) and model.temperature == again.temperature


def plain_grams(text: str) -> Counter:
    """Features by a loop over n-grams."""
    text = " " + " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()) + " "
    counts = Counter()
    for n in language.GRAMS:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x01000193 + ord(c) + 1) % 2**32
            counts[((h ^ h >> 15) * 0x9E3779B1) % 2**32 >> 32 - language.BITS] += 1
    return counts


def test_language_scores_equal_a_plain_sum(tongues, monkeypatch):
    model = language.train(tongues)
    monkeypatch.setattr(language, "BLOCK", 50)  # n-grams across blocks count once
    for text in ("abc", "ééà  bd, çç 12 dd", babble(random.Random(1), "bb", 200)):
        counts = plain_grams(text)
        features, shares = language.term_frequencies(text)
        assert dict(zip(features.tolist(), np.rint(shares * counts.total()).astype(int).tolist())) == counts
        mean = sum(n * model.weights[f].astype(float) for f, n in counts.items()) / counts.total()
        p = np.exp((mean + model.intercept) / model.temperature)
        assert np.allclose(language.probabilities(text, model), p / p.sum())


def test_follow_the_leader_steps():
    """One feature, two rows: weights follow the published update."""
    rows = language.Rows(np.array([0, 1]), np.array([0, 1, 1]), np.array([5]), np.array([1.0]))
    idf = np.ones(1 << language.BITS)
    epochs, language.EPOCHS = language.EPOCHS, 1
    try:
        weights, intercept = language.follow_the_leader(rows, np.array([0, 1]), idf, 2)
    finally:
        language.EPOCHS = epochs
    g = np.array([-0.5, 0.5]) / 2 * language.SCALE
    z, n = g, g * g
    w = -(z - np.sign(z) * language.L1) / ((language.BETA + np.sqrt(n)) / language.ALPHA + language.L2)
    assert np.allclose(weights[5], w * language.SCALE) and np.allclose(intercept, 0)
    assert np.count_nonzero(weights) == 2


def test_temperature_mends_overconfidence():
    draw = np.random.default_rng(2)
    label = draw.integers(0, 2, 4000)
    logits = np.stack([np.zeros(4000), np.where(draw.random(4000) < 0.75, 1, -1) * (2 * label - 1) * 9.0], axis=1)
    t = language.temperature_of(logits, label)
    assert abs(9 / t - np.log(3)) < 0.15  # three of four are right


def test_language_on_awkward_rows(spark, odd, none, tongues):
    model = language.train(tongues)
    rows = language.identified(odd, model)
    assert sorted(rows.columns) == sorted(odd.columns)
    for r in rows.collect():
        letters = any(unicodedata.category(c)[0] == "L" for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert rows.count() == odd.count() and language.identified(none, model).count() == 0
    nothing = language.train(none)
    assert {r.lang_pred for r in language.identified(odd, nothing).collect()} == {"und"}
    alone = language.train(odd.where("lang = 'fr'"))
    assert alone.languages == ["fr"]


def test_registered_language_query(spark, folder):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op13_language_id"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.93
