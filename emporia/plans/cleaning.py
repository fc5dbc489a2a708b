from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emporia.operators import clean
from emporia.plans.registry import register
from emporia.plans.views import COERCED, DIRTY, FACT, NAMED, NORMAL, SALES, VALID
from emporia.schema import NUMBER_COLUMNS, SOURCE_TO_CANONICAL
from emporia.sources.purchases import canonical_columns, normalize_columns, read_purchases
from emporia.sources.star import dirty_sales, sales
from emporia.sources.store import shared_dir


def coerced(spark, folder):
    return clean.coerce_types(dirty_sales(spark, folder))


def valid(spark, folder):
    return clean.filter_valid(coerced(spark, folder))


def normal(spark, folder):
    return clean.normalize_text(valid(spark, folder))


def named(spark, folder):
    return clean.drop_nullish(normal(spark, folder))


def fact(spark, folder):
    return clean.clean_purchases(dirty_sales(spark, folder)).fact


@register(
    "read_purchases",
    f"""WITH {DIRTY} SELECT client_id, purchase_date, product_id, product_name, brand, category, delegation,
    locality, TRY_CAST(quantity AS DOUBLE) AS quantity, TRY_CAST(unit_price AS DOUBLE) AS unit_price,
    TRY_CAST(total_price AS DOUBLE) AS total_price FROM dirty""",
)
def q_read_purchases(spark, folder):
    """The raw rows, written as the purchase file and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/emporia/{uuid.uuid4().hex}"
    headers = {v: k for k, v in SOURCE_TO_CANONICAL.items()}
    (
        dirty_sales(spark, folder).withColumnsRenamed(headers)
        .write.options(sep=";", header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        .csv(path)
    )
    rows = canonical_columns(read_purchases(spark, path))
    return rows.withColumns({c: F.col(c).try_cast("double") for c in NUMBER_COLUMNS})


@register(
    "normalize_columns",
    f"""WITH {SALES} SELECT client_id, purchase_date AS date_dachat, product_name AS nom_produit,
    category AS categorie, total_price AS prix_total FROM sales""",
)
def q_normalize_columns(spark, folder):
    columns = ["client_id", "purchase_date", "product_name", "category", "total_price"]
    raw = sales(spark, folder, *columns).toDF(
        " Client Id", "Date d'achat", "Nom Produit ", "CatÃ©gorie", "PRIX TOTAL"
    )
    return normalize_columns(raw)


register("coerce_types", f"WITH {COERCED} SELECT * FROM coerced")(coerced)
register("filter_valid", f"WITH {VALID} SELECT * FROM valid")(valid)
register("normalize_text", f"WITH {NORMAL} SELECT * FROM normal")(normal)
register("drop_nullish", f"WITH {NAMED} SELECT * FROM named")(named)
register("clean_purchases", f"WITH {FACT} SELECT * FROM fact")(fact)


@register("dedup_purchases", f"WITH {FACT} SELECT * FROM single")
def q_dedup(spark, folder):
    return clean.dedup_purchases(named(spark, folder))


@register(
    "add_revenue",
    f"WITH {SALES} SELECT client_id, product_id, quantity, unit_price, revenue FROM sales",
)
def q_add_revenue(spark, folder):
    return clean.add_revenue(sales(spark, folder, "client_id", "product_id", "quantity", "unit_price"))


@register("dim_product", f"WITH {FACT} SELECT * FROM dim")
def q_dim_product(spark, folder):
    return clean.clean_purchases(dirty_sales(spark, folder)).products


@register(
    "semi_valid_products",
    f"""WITH {FACT} SELECT client_id, purchase_date, product_id, total_price FROM sales s
    WHERE EXISTS (SELECT 1 FROM dim WHERE dim.product_id IS NOT DISTINCT FROM s.product_id)""",
)
def q_semi_valid_products(spark, folder):
    """All purchases whose product is in the dimension of the cleaned ones."""
    rows = sales(spark, folder, "client_id", "purchase_date", "product_id", "total_price")
    return clean.semi_valid_products(rows, q_dim_product(spark, folder))
