from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from emporia.operators import basket

CATEGORY = {"bread": "bakery", "butter": "dairy", "milk": "dairy", "soap": "hygiene", "tea": "drinks"}
COPIES = [
    ("bread butter", 4), ("bread butter milk", 2), ("bread milk", 1), ("bread milk tea", 1), ("butter", 1),
    ("milk soap", 1), ("milk tea", 3), ("milk", 2), ("soap", 3), ("soap tea", 2),
]
EXPECTED = {
    ("bread", "butter"): (6, 75.0, 2.14, 312.74, "a_eloigner"),
    ("bread", "milk"): (4, 50.0, 1.0, 80.47, "neutres"),
    ("bread", "tea"): (1, 12.5, 0.42, 5.21, "a_rapprocher"),
    ("butter", "milk"): (2, 28.6, 0.57, 16.33, "a_rapprocher"),
    ("milk", "soap"): (1, 10.0, 0.33, 3.33, "a_rapprocher"),
    ("milk", "tea"): (4, 40.0, 1.33, 85.84, "neutres"),
    ("soap", "tea"): (2, 33.3, 1.11, 40.69, "neutres"),
}


@pytest.fixture(scope="module")
def fact(spark):
    baskets = [names.split() for names, n in COPIES for _ in range(n)]
    rows = [
        (f"c{i}", f"2020-01-{i % 9 + 1:02d}", f" {name} ", CATEGORY[name], 1.0)
        for i, names in enumerate(baskets)
        for name in names
    ]
    return spark.createDataFrame(
        rows, "client_id string, purchase_date string, product_name string, category string, quantity double"
    ).withColumn("purchase_date", F.to_date("purchase_date"))


def table(spark, baskets):
    rows = [(f"c{i}", "d", name) for i, names in enumerate(baskets) for name in names]
    return basket.basket_table(spark.createDataFrame(rows, "client_id string, purchase_date string, item string"))


def brute_pairs(baskets):
    return Counter(pair for names in baskets for pair in combinations(sorted(set(names)), 2))


def counted(df):
    return {(r.x, r.y): r.frequency for r in df.collect()}


def test_large_baskets_are_cut_into_blocks_exactly(spark):
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(40)]
    baskets = [rng.sample(names, rng.choice([1, 2, 3, 5, 9, 10, 11, 25, 40])) for _ in range(60)]
    stored = table(spark, baskets)
    for block in (256, 10, 4, 1):
        assert counted(basket.pair_counts(stored, block=block)) == brute_pairs(baskets)


def test_placement_on_hand_made_baskets(fact):
    rows = basket.placement_pairs(fact).collect()
    assert {(r.x, r.y): (r.frequency, r.confidence, r.lift, r.score, r["class"]) for r in rows} == EXPECTED


def test_placement_lists_and_tips(fact):
    ranked = basket.placement(fact)
    listed = {(r["class"], r["rank"]): (r.x, r.y) for r in ranked.collect()}
    assert listed[("a_eloigner", 1)] == ("bread", "butter")
    assert [listed[("a_rapprocher", i)] for i in (1, 2, 3)] == [("milk", "soap"), ("bread", "tea"), ("butter", "milk")]
    tips = {r["class"]: r.products for r in basket.placement_tips(ranked).collect()}
    assert tips == {
        "a_eloigner": "bread + butter", "a_rapprocher": "milk + soap, bread + tea, butter + milk",
    }


def test_slice_counts_only_its_rows(fact):
    pairs = basket.placement_pairs(fact, category="dairy").collect()
    assert [(r.x, r.y, r.frequency) for r in pairs] == [("butter", "milk", 2)]


def test_baskets_without_usable_items_count_in_placement(spark, fact):
    blank = spark.createDataFrame([("z", None, "x", 1.0)], "client_id string, product_name string, category string, quantity double")
    more = fact.unionByName(blank.withColumn("purchase_date", F.to_date(F.lit("2020-01-01"))))
    rows = {(r.x, r.y): r.lift for r in basket.placement_pairs(more).collect()}
    assert rows[("bread", "milk")] == round(4 / (8 * 10 / 21), 2)


def test_layout(fact):
    rows = {(r.x, r.y): r for r in basket.layout_pairs(fact).collect()}
    assert {k: (r.frequency, round(r.confidence, 1), round(r.lift, 4), r["class"], r.association) for k, r in rows.items()} == {
        ("bakery", "dairy"): (8, 100.0, 1.1667, "a_eloigner", "positive"),
        ("drinks", "hygiene"): (2, 33.3, 1.5556, "a_eloigner", "positive"),
        ("bakery", "drinks"): (1, 12.5, 0.2917, "a_rapprocher", "negative"),
        ("dairy", "drinks"): (4, 33.3, 0.7778, "a_rapprocher", "negative"),
        ("dairy", "hygiene"): (1, 8.3, 0.3889, "a_rapprocher", "negative"),
    }
    actions = [(r.x, r.action) for r in basket.layout_action(basket.layout(fact)).collect()]
    assert actions[0] == ("bakery", "À rapprocher") and actions[-1] == ("drinks", "À éloigner")


def test_analyze_pairs(spark, fact):
    pairs = spark.createDataFrame(
        [("BREAD", "butter"), ("tea", "bread"), ("butter", "tea"), ("soap", "te"), ("milk", "milk"), ("zzz", "milk")],
        "product_1 string, product_2 string",
    )
    clean = fact.withColumn("product_name", F.trim("product_name"))
    rows = {(r.product_1, r.product_2): r for r in basket.analyze_pairs(clean, pairs).collect()}
    strong = rows[("BREAD", "butter")]
    assert (strong.support_1, strong.support_2, strong.frequency, strong.basket_count) == (8, 7, 6, 20)
    assert (strong.confidence, strong.confidence_reverse, strong.lift) == (75.0, 85.7, 2.14)
    assert strong.score == round(85.7 * 2.14 * math.log1p(6), 2) and strong.tier == "strong" and strong.together
    assert rows[("tea", "bread")].tier == "moderate" and not rows[("tea", "bread")].together
    assert (rows[("butter", "tea")].frequency, rows[("butter", "tea")].tier) == (0, "none")
    assert rows[("soap", "te")].tier == "often"
    assert rows[("milk", "milk")].frequency == 10
    assert rows[("zzz", "milk")].missing == "zzz" and rows[("zzz", "milk")].tier == "unknown"


def test_weak_tier(spark):
    resolved = spark.createDataFrame(
        [("a", "b", "a", "b")], "product_1 string, product_2 string, matched_1 string, matched_2 string"
    )
    support = spark.createDataFrame([("a", 40), ("b", 25)], "item string, support long")
    counts = spark.createDataFrame([("a", "b", 1)], "x string, y string, frequency long")
    row = basket.score_pairs(resolved, support, counts, F.lit(1000)).first()
    assert (row.confidence_reverse, row.lift, row.score, row.tier) == (4.0, 1.0, 2.77, "weak")


def test_related_products_fall_back_when_none_passes(fact):
    metrics = basket.pair_metrics(fact)
    best = basket.related_products(metrics, "bread", n=2).orderBy("rank").collect()
    assert [r.neighbour for r in best] == ["butter", "milk"]
    strict = basket.related_products(metrics, "bread", n=5, min_confidence=60).collect()
    assert [r.neighbour for r in strict] == ["butter"]
    none_passes = basket.related_products(metrics, "bread", n=2, min_confidence=99).orderBy("rank").collect()
    assert [r.neighbour for r in none_passes] == ["butter", "milk"]


def test_pair_properties(fact):
    metrics = basket.pair_metrics(fact).collect()
    assert all(r.frequency <= min(r.support_x, r.support_y) for r in metrics)
    assert all(r.n == 20 for r in metrics)
    stored = basket.basket_table(basket.basket_items(fact))
    supports = basket.item_support(stored).agg(F.sum("support")).first()[0]
    assert supports == stored.agg(F.sum("size")).first()[0]


def test_repeated_purchases_count_once_in_a_basket_table(spark):
    rows = [("c1", "d", "b"), ("c1", "d", "a"), ("c1", "d", "b"), ("c2", "d", None), ("c2", "d", None)]
    table = basket.basket_table(spark.createDataFrame(rows, "client_id string, purchase_date string, item string"))
    assert sorted((r["items"], r["size"]) for r in table.collect()) == [([], 0), (["a", "b"], 2)]
