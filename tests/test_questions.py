from __future__ import annotations

import contextlib
import io
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from emporia.operators import questions as q
from emporia.sources.store import work_table

TURNS = [
    (1, 0, "Quel est le produit le plus acheté à Bizerte ?"),
    (1, 1, "Et a SFAX ?"),
    (1, 2, "Top 3 produits dans boissons"),
    (1, 3, "c est les memes a tunis ?"),
    (2, 0, "et a Sfax c est les memes ?"),
    (2, 1, "Compare Tunis et Sfax"),
    (2, 2, "Quels produits sont achetés ensemble à Tunis ?"),
    (2, 3, 'Analyse "lait" avec \'pain\''),
    (3, 0, "Quelles catégories ?"),
    (3, 1, "Sfax"),
    (3, 2, "Sfax, Tunis"),
    (3, 3, "un résumé"),
    (3, 4, "bonjour"),
    (4, 0, "top 99999999999999999999"),
    (5, 0, "top 0 produits à Tunis"),
    (5, 1, "et a Sfax ?"),
    (6, 0, "Quel est le produit le plus acheté à Sfax, top 3 ?"),
    (6, 1, "Analyse de pair \" \" avec 'pain'"),
]


@pytest.fixture(scope="module")
def fact(spark):
    rows = [("boissons", "Sfax", "eau", "c1", 3), ("frais", "Sfax", "lait", "c1", 2), ("frais", "Tunis", "lait", "c2", 2),
            ("frais", "Tunis", "pain", "c2", 4), ("frais", "Bizerte", "pain", "c3", 1), ("boissons", None, "jus", "c4", 5)]
    df = spark.createDataFrame(rows, "category string, delegation string, product_name string, client_id string, n int")
    return df.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).withColumn("purchase_date", F.to_date(F.lit("2020-01-01")))


@pytest.fixture(scope="module")
def routed(spark, fact):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, text string")
    return q.route_questions(q.extract_filters(table, fact, fact), fact)


def test_filters(spark, fact):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, text string")
    rows = {(r.conv_id, r.turn): r for r in q.extract_filters(table, fact, fact).collect()}
    assert (rows[(1, 0)].top_n, rows[(1, 0)].single_product, rows[(1, 0)].delegation) == (1, True, "Bizerte")
    assert (rows[(1, 2)].top_n, rows[(1, 2)].category) == (3, "boissons")
    assert rows[(2, 1)].regions == ["Sfax", "Tunis"] and rows[(2, 1)].delegation == "Tunis" and rows[(2, 1)].is_comparison
    assert rows[(2, 3)].products == ["lait", "pain"]
    assert rows[(4, 0)].top_n == 2**63 - 1


def test_routes(routed):
    found = {(r.conv_id, r.turn): (r.intent, r.previous_region) for r in routed.collect()}
    assert found == {
        (1, 0): ("top_products", None), (1, 1): ("comparison", "Bizerte"), (1, 2): ("top_products", None),
        (1, 3): ("comparison", "Bizerte"), (2, 0): ("top_products", None), (2, 1): ("comparison", None),
        (2, 2): ("basket", None), (2, 3): ("basket", None), (3, 0): ("categories", None), (3, 1): ("top_products", None),
        (3, 2): ("comparison", None), (3, 3): ("insights", None), (3, 4): ("general", None), (4, 0): ("top_products", None),
        (5, 0): ("top_products", None), (5, 1): ("top_products", None), (6, 0): ("top_products", None), (6, 1): ("basket", None),
    }


def test_top_answers(routed, fact):
    rows = q.answer_top_products(routed, fact).collect()
    of = {}
    assert {(r.conv_id, r.turn) for r in rows if r.status == q.NO_PRODUCT} == {(5, 0)}
    for r in sorted(rows, key=lambda r: r["rank"] or 0):
        of.setdefault((r.conv_id, r.turn), []).append((r.product_name, r.row_count))
    assert of[(1, 0)] == [("pain", 1)]
    assert of[(6, 0)] == [("eau", 3)]
    assert of[(1, 2)] == [("jus", 5), ("eau", 3)]
    assert of[(3, 1)] == [("eau", 3), ("lait", 2)]
    assert of[(4, 0)] == [("jus", 5), ("pain", 5), ("lait", 4), ("eau", 3)]


def test_comparisons(routed, fact):
    rows = q.answer_comparisons(routed, fact).where("conv_id = 2").orderBy("side", "rank").collect()
    assert [(r.region, r.product_name, r.row_count, r.common) for r in rows] == [
        ("Sfax", "eau", 3, False), ("Sfax", "lait", 2, True), ("Tunis", "pain", 4, False), ("Tunis", "lait", 2, True),
    ]
    follow = q.answer_comparisons(routed, fact).where("conv_id = 1 AND turn = 1").orderBy("side", "rank").collect()
    assert [r.region for r in follow] == ["Bizerte", "Sfax", "Sfax"]


def test_pair_answers(routed, fact):
    rows = {(r.turn, r["rank"]): r for r in q.answer_pairs(routed, fact).collect()}
    assert set(rows) == {(2, 1), (3, 1), (1, None)} and rows[(1, None)].status == q.TWO_NAMES
    assert (rows[(2, 1)].product_1, rows[(2, 1)].product_2, rows[(2, 1)].frequency) == ("lait", "pain", 1)
    # One of two baskets each, among four: lift 1, score 50 · ln 2 = 34.66.
    assert (rows[(3, 1)].confidence, rows[(3, 1)].tier) == (50.0, "often")


@pytest.mark.parametrize("chunk", [1, 3, 10_000])
def test_carry_last_in_stretches(spark, chunk):
    values = [None, "a", None, None, "b", None, None, None, None, "c", None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, t long, v string")
    found = [r.before for r in q.carry_last(df, "g", "t", "v", "before", chunk).orderBy("t").collect()]
    assert found == [None, None, "a", "a", "a", "b", "b", "b", "b", "b", "c"]


def test_pairs_of_slices_agree_with_a_count_of_each(spark):
    """Repeated purchases, items sold in two categories or places, missing and empty names of slices and items."""
    draw = random.Random(3)
    rows = [
        (f"c{draw.randrange(6)}", f"2020-01-0{draw.randrange(1, 4)}", draw.choice([" a", "a", "b", "c", "d", " ", None]),
         draw.choice(["x", "y", "", None]), draw.choice(["north", "south", None]))
        for _ in range(150)
    ] * 2
    df = spark.createDataFrame(rows, "client_id string, purchase_date string, product_name string, category string, delegation string")
    asked = [("", ""), ("x", ""), ("", "south"), ("y", "north"), ("z", "")]
    expected = {}
    for category, delegation in asked:
        baskets = {}
        for client, date, name, c, d in rows:
            if name and name.strip() and category in ("", c) and delegation in ("", d):
                baskets.setdefault((client, date), set()).add(name.strip())
        for held in baskets.values():
            for x, y in combinations(sorted(held), 2):
                expected[(category, delegation, x, y)] = expected.get((category, delegation, x, y), 0) + 1
    found = q.sliced_pairs(df, spark.createDataFrame(asked * 2, "in_category string, in_delegation string"), 100).collect()
    assert {(r.in_category, r.in_delegation, r.x, r.y): r.frequency for r in found} == expected and expected


def test_slices_share_one_shuffle_of_the_purchases(spark, monkeypatch):
    """A purchase is not copied to its slices before baskets are made, and repeated ones need no shuffle of their own."""
    plans = []
    monkeypatch.setattr(q, "work_table", lambda df: (plans.append(df), work_table(df))[1])
    df = spark.createDataFrame([("c", "2020-01-01", n, "x", "north") for n in "abcab"], "client_id string, purchase_date string, product_name string, category string, delegation string")
    q.sliced_pairs(df, spark.createDataFrame([("", ""), ("x", "")], "in_category string, in_delegation string"), 5).collect()
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        plans[-1].explain()
    assert text.getvalue().count("Exchange hashpartitioning") == 1
