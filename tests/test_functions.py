from __future__ import annotations

import random

from pyspark.sql import functions as F

from emporia.functions import month_start, plain_words, py_round, quoted_names, season
from emporia.functions.text import contained_names, contains_join


def test_py_round_is_pythons_round(spark):
    rng = random.Random(7)
    values = [35.15, 6.25, 2.675, -0.04, 0.0, 1234567.125, 12.75, 99.95, 1e9 + 0.05]
    values += [round(rng.uniform(-1000, 1000), 3) for _ in range(400)]
    values += [rng.randint(1, 99) / rng.randint(1, 400) * 100 for _ in range(400)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = df.select("v", *[py_round(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2)]).collect()
    for row in rows:
        assert [row.d0, row.d1, row.d2] == [round(row.v), round(row.v, 1), round(row.v, 2)]


def test_py_round_keeps_null_and_infinity(spark):
    df = spark.createDataFrame([(None,), (float("inf"),)], "v double")
    assert [r[0] for r in df.select(py_round(F.col("v"), 2)).collect()] == [None, float("inf")]


def test_seasons_and_months(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2020-01-15', DATE'2020-12-15', INTERVAL 1 MONTH)) AS d")
    rows = df.orderBy("d").select(season(F.col("d")), month_start(F.col("d"))).collect()
    expected = ["Hiver"] * 2 + ["Printemps"] * 3 + ["Été"] * 3 + ["Automne"] * 3 + ["Hiver"]
    assert [r[0] for r in rows] == expected
    assert all(r[1].day == 1 for r in rows)


def test_words_and_quotes(spark):
    df = spark.createDataFrame([("la crème-brûlée et \"pain d'épi\" ou 'lait'",)], "t string")
    words, quoted = df.select(plain_words(F.col("t")), quoted_names(F.col("t"))).first()
    assert words[:3] == ["la", "crème", "brûlée"]
    assert quoted == ["pain d'épi", "lait"]


def brute(texts, needles):
    return sorted((t, n) for t in texts for n in needles if n in t)


def test_contains_join_matches_brute_force(spark):
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 30))) for _ in range(200)})
    needles = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    left = spark.createDataFrame([(t,) for t in texts], "t string")
    right = spark.createDataFrame([(n,) for n in needles], "n string")
    found = contains_join(left, "t", right, "n").select("t", "n").collect()
    assert sorted(map(tuple, found)) == brute(texts, needles)


def test_contains_join_with_shared_beginnings(spark):
    """All needles begin alike, and texts end in the middle of one."""
    needles = ["red", "red ", "red ring", "red rings", "red rod"]
    texts = ["a red ring", "two red rings, red rod", "red", "redred", "blue", "re"]
    left = spark.createDataFrame([(t,) for t in texts], "t string")
    right = spark.createDataFrame([(n,) for n in needles], "n string")
    found = contains_join(left, "t", right, "n").select("t", "n").collect()
    assert sorted(map(tuple, found)) == brute(texts, needles)


def test_contained_names(spark):
    texts = spark.createDataFrame(
        [(1, 0, "Tunis et SFAX"), (1, 1, "rien"), (2, 0, "grand tunis"), (2, 1, None)], "conv_id int, turn int, text string"
    )
    names = spark.createDataFrame([("Tunis",), ("Sfax",), ("Grand Tunis",), (None,), ("",)], "name string")
    expected = {(1, 0): ["Sfax", "Tunis"], (1, 1): [], (2, 0): ["Grand Tunis", "Tunis"], (2, 1): []}
    more = spark.createDataFrame([("TUNIS",), ("Rien",)], "kind string")
    rows = contained_names(texts, "text", {"found": (names, "name"), "kinds": (more, "kind")}).collect()
    assert {(r.conv_id, r.turn): r.found for r in rows} == expected
    assert {(r.conv_id, r.turn): r.kinds for r in rows} == {
        (1, 0): ["TUNIS"], (1, 1): ["Rien"], (2, 0): ["TUNIS"], (2, 1): [],
    }


def test_contains_join_over_stretches(spark):
    """Needles across the seams of long texts are found once."""
    texts = ["x" * n + "needle" + "y" * 700 + "needle" for n in (0, 250, 253, 256, 511)]
    left = spark.createDataFrame([(t,) for t in texts], "t string")
    right = spark.createDataFrame([("needle",), ("needley",), ("xneedle",), ("zz",), ("",)], "n string")
    found = sorted(map(tuple, contains_join(left, "t", right, "n").select("t", "n").collect()))
    assert found == brute(texts, ["needle", "needley", "xneedle", "zz"])


def test_contains_join_with_a_very_long_needle(spark):
    """A needle of 10,000 characters is found, also across seams, and the short ones beside it still are."""
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef") for _ in range(10_000))
    texts = [long, "zz" + long + "red", "z" * 9_990 + long + long, long[:-1], long[1:] + "red", "a red text"]
    needles = [long, long[:5_000], long[2_000:9_000], "red", "re", long + "x"]
    left = spark.createDataFrame([(t,) for t in texts], "t string")
    right = spark.createDataFrame([(n,) for n in needles], "n string")
    found = contains_join(left, "t", right, "n").select("t", "n").collect()
    assert sorted(map(tuple, found)) == brute(texts, needles)
