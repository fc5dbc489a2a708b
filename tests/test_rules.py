from __future__ import annotations

import random
from itertools import combinations

import pytest

from emporia.operators import rules
from emporia.schema import BASKET_KEYS


def baskets():
    rng = random.Random(11)
    letters = "abcdefg"
    made = [sorted(rng.sample(letters, rng.randint(0, 5))) for _ in range(120)]
    return [names + ["h"] if "a" in names else names for names in made]


def brute(rows, min_support, max_len):
    letters = sorted({x for names in rows for x in names})
    found = {}
    for k in range(1, max_len + 1):
        for items in combinations(letters, k):
            count = sum(set(items) <= set(names) for names in rows)
            if count >= min_support * len(rows):
                found[items] = count
    return found


@pytest.fixture(scope="module")
def matrix(spark):
    """Every basket also holds a returned item, so empty baskets count."""
    rows = [(f"c{i}", "d", x, True) for i, names in enumerate(baskets()) for x in names]
    rows += [(f"c{i}", "d", "returned", False) for i in range(len(baskets()))]
    return spark.createDataFrame(rows, "client_id string, purchase_date string, item string, present boolean")


def test_levels_match_brute_force(matrix):
    expected = brute(baskets(), 0.05, 8)
    found = rules.frequent_itemsets(matrix, BASKET_KEYS, 0.05)
    assert {tuple(r["items"]): r["count"] for r in found.collect()} == expected
    assert {r.n for r in found.collect()} == {120}


def test_length_limit(matrix):
    found = rules.frequent_itemsets(matrix, BASKET_KEYS, 0.05, max_len=2).collect()
    assert {tuple(r["items"]): r["count"] for r in found} == brute(baskets(), 0.05, 2)


def test_fp_growth_agrees(spark):
    df = spark.createDataFrame([(names,) for names in baskets()], "items array<string>")
    found = rules.fp_itemsets(df, 0.05).collect()
    assert {tuple(r["items"]): r["count"] for r in found} == brute(baskets(), 0.05, 8)


def test_rules_match_brute_force(matrix):
    itemsets = brute(baskets(), 0.05, 8)
    n = 120
    expected = {}
    for items, joint in itemsets.items():
        for k in range(1, len(items)):
            for left in combinations(items, k):
                right = tuple(x for x in items if x not in left)
                if joint * n >= itemsets[left] * itemsets[right]:
                    expected[(left, right)] = (joint / itemsets[left], joint * n / (itemsets[left] * itemsets[right]))
    found = rules.association_rules(rules.frequent_itemsets(matrix, BASKET_KEYS, 0.05)).collect()
    assert {(tuple(r.antecedents), tuple(r.consequents)) for r in found} == set(expected)
    for r in found:
        confidence, lift = expected[(tuple(r.antecedents), tuple(r.consequents))]
        assert r.confidence == pytest.approx(confidence) and r.lift == pytest.approx(lift)
    assert any(len(r.consequents) > 1 for r in found)
    assert any(r.conviction == float("inf") for r in found)


def test_returned_items_are_absent_but_their_baskets_count(spark):
    fact = spark.createDataFrame(
        [("c1", "x", 2.0), ("c1", "y", 1.0), ("c1", "y", -1.0), ("c2", "x", -3.0)],
        "client_id string, product_name string, quantity double",
    )
    assert {r.client_id: r["items"] for r in rules.baskets_by_client(fact).collect()} == {"c1": ["x"], "c2": []}
    itemsets = rules.frequent_itemsets(rules.presence(fact, ["client_id"]), ["client_id"]).collect()
    assert [(r["items"], r["count"], r.n) for r in itemsets] == [(["x"], 1, 2)]


def test_matrix_corner(spark):
    rows = [(f"c{i}", f"p{j}", True) for i in range(5) for j in range(5)]
    corner = rules.cap_matrix(spark.createDataFrame(rows, "client_id string, item string, present boolean"), "client_id", 2, 3)
    assert {(r.client_id, r["item"]) for r in corner.collect()} == {(f"c{i}", f"p{j}") for i in range(2) for j in range(3)}
