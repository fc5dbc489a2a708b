from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from emporia.operators import clean
from emporia.sources.purchases import canonical_columns, normalized_name, read_purchases
from emporia.sources.star import sales
from emporia.sources.store import read_fact, write_fact

COLUMNS = (
    "client_id string, purchase_date string, product_id string, product_name string, brand string, "
    "category string, delegation string, locality string, quantity string, unit_price string, total_price string"
)


def raw(spark, *changes):
    base = [" 7 ", "03/02/2020", "p1", " Lait ", "B", "Frais", "Tunis", "Bardo", "2", "1.5", "3"]
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = [tuple({**dict(zip(names, base)), **change}.values()) for change in changes]
    return spark.createDataFrame(rows, COLUMNS)


def test_header_names():
    assert normalized_name(" Date d'achat ") == "date_dachat"
    assert normalized_name("CatÃ©gorie") == "categorie"


def test_purchase_file(spark, tmp_path):
    lines = [
        "\ufeffClient Id;Date d'achat;Prix;Nom",
        "1;03/02/2020;2.5;lait",
        "2;04/02/2020",
        "3;04/02/2020;1;pain;trop",
        "4;n/d;1;pain",
        '5;05/02/2020;2,5;"pain; complet"',
        "6;05/02/2020;NaN;",
        '7;05/02/2020;1;"a;b";trop',
    ]
    path = tmp_path / "achats.csv"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    df = read_purchases(spark, str(path))
    assert df.columns == ["client_id", "date_dachat", "prix", "nom"]
    rows = {r.client_id: tuple(r)[1:] for r in df.collect()}
    assert rows == {
        "1": ("03/02/2020", "2.5", "lait"),
        "2": ("04/02/2020", None, None),
        "4": ("n/d", "1", "pain"),
        "5": ("05/02/2020", "2,5", "pain; complet"),
        "6": ("05/02/2020", None, None),
    }


def test_french_headers_become_canonical(spark):
    df = spark.createDataFrame([("1", "x", "y")], ["client_id", "produit_acheté", "délégation"])
    assert canonical_columns(df).columns == ["client_id", "product_id", "delegation"]


def test_coercion(spark):
    df = raw(
        spark,
        {"quantity": "2,5"}, {"quantity": "1d"}, {"quantity": " 4 "}, {"quantity": "1e2"},
        {"purchase_date": "31/02/2020"}, {"purchase_date": "1/2/2020"},
    )
    rows = clean.coerce_types(df).collect()
    assert [r.quantity for r in rows[:4]] == [None, None, 4.0, 100.0]
    assert [r.purchase_date for r in rows[4:]] == [None, dt.date(2020, 2, 1)]


def test_whole_chain(spark):
    df = raw(
        spark,
        {}, {}, {"product_id": "p2", "quantity": "-1"}, {"client_id": None}, {"total_price": "0"},
        {"unit_price": "abc"}, {"brand": " N/A "}, {"category": "Inconnu"}, {"delegation": None, "product_id": "p3"},
        {"product_id": None}, {"product_id": None},
    )
    fact, products = clean.clean_purchases(df)
    rows = fact.collect()
    assert sorted((r.product_id or "") for r in rows) == ["", "p1", "p2", "p3"]
    kept = next(r for r in rows if r.product_id == "p1")
    assert (kept.client_id, kept.product_name, kept.brand, kept.category) == ("7", "lait", "b", "frais")
    assert kept.revenue == 3.0
    assert next(r for r in rows if r.product_id == "p2").revenue == -1.5
    assert products.count() == 4
    assert clean.semi_valid_products(fact, products).count() == 4
    assert clean.semi_valid_products(fact, products.where("product_id IS NOT NULL")).count() == 3


def test_dedup_keeps_the_first_by_the_given_order(spark):
    df = clean.coerce_types(raw(spark, {"locality": "b"}, {"locality": "a"})).withColumn(
        "line", F.when(F.col("locality") == "b", 1).otherwise(2)
    )
    assert clean.dedup_purchases(df).first().locality == "a"
    assert clean.dedup_purchases(df, ["line"]).first().locality == "b"
    assert clean.dedup_purchases(df, ["line"]).columns == df.columns


def test_trimmed_joins_lose_no_row(spark, folder):
    full = sales(spark, folder).agg(F.count("*"), F.sum("quantity")).first()
    for columns in (["quantity"], ["quantity", "brand"], ["quantity", "client_id"], ["quantity", "locality"]):
        assert sales(spark, folder, *columns).agg(F.count("*"), F.sum("quantity")).first() == full


def test_saved_fact(spark, folder, tmp_path):
    fact = sales(spark, folder)
    write_fact(fact, str(tmp_path / "fact"))
    again = read_fact(spark, str(tmp_path / "fact"))
    assert again.count() == fact.count()
    pruned = again.where("purchase_year = 1996")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(purchase_year" in pruned
