from __future__ import annotations

import random
import re

from emporia.operators import lookup

NAMES = [
    "Lait entier", "Lait demi", "Crème fraîche", "Pain complet", "Pain de mie complet", "Eau", "eau gazeuse",
    "the vert bio a la menthe du jardin des plantes sauvages",
]


def brute_match(text, names):
    low = text.lower().strip()
    if not low:
        return None
    names = sorted(names)
    exact = [n for n in names if n.lower() == low]
    starts = [n for n in names if n.lower().startswith(low)]
    words = re.findall(r"\w+", low)
    scores = {n: sum(w in re.findall(r"\w+", n.lower()) for w in words) for n in names}
    best = max(scores.values())
    shared = [n for n in names if scores[n] == best and best > 0]
    inside = [n for n in names if len(low) >= 4 and low in n.lower()]
    return next(iter(exact + starts + shared + inside), None)


def test_names_match_like_brute_force(spark):
    rng = random.Random(2)
    vocabulary = sorted({w for n in NAMES for w in n.lower().split()}) + ["xyz"]
    texts = NAMES + [" lait ", "LAI", "omplet", "mple", "ait", "zzz", "  ", "é", "crème"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    products = spark.createDataFrame([(n,) for n in NAMES], "product_name string")
    queries = spark.createDataFrame([(t,) for t in texts], "query string")
    found = {r["query"]: r.matched for r in lookup.match_product_name(queries, products).collect()}
    assert found == {t: brute_match(t, NAMES) for t in texts}


def test_categories_resolve(spark):
    categories = spark.createDataFrame([("Boissons",), ("boissons",), ("Frais",), (None,)], "category string")
    queries = spark.createDataFrame(
        [("Frais",), ("BOISSONS",), ("rayon frais",), ("sson",), ("jouets",), ("",), (None,)], "query string"
    )
    found = {r["query"]: r.category for r in lookup.resolve_category(queries, categories).collect()}
    assert found == {
        "Frais": "Frais", "BOISSONS": "boissons", "rayon frais": "Frais", "sson": "Boissons",
        "jouets": "jouets", "": "Boissons", None: "Boissons",
    }


def test_lists_leave_out_nulls(spark):
    fact = spark.createDataFrame(
        [("a", "X", "x1"), (None, "Y", "y1"), ("b", None, "n"), ("a", "X", None)],
        "category string, delegation string, locality string",
    )
    assert [r[0] for r in lookup.list_categories(fact).collect()] == ["a", "b"]
    assert [r[0] for r in lookup.list_delegations(fact).collect()] == ["X", "Y"]
    assert [r[0] for r in lookup.list_localities(fact, "X").collect()] == ["x1"]
    renamed = fact.withColumnRenamed("category", "product_id")
    assert [r[0] for r in lookup.list_categories(renamed).collect()] == ["a", "b"]


def test_search_is_literal(spark):
    fact = spark.createDataFrame([("a.b",), ("axb",), (None,)], "product_name string")
    assert [r[0] for r in lookup.search_products(fact, "A.B").collect()] == ["a.b"]
    assert len(lookup.search_products(fact).collect()) == 2
