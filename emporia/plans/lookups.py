from __future__ import annotations

from pyspark.sql import functions as F

from emporia.operators import lookup
from emporia.plans.registry import register
from emporia.plans.views import SALES
from emporia.sources.star import sales, table


@register("list_categories", f"WITH {SALES} SELECT DISTINCT category FROM sales WHERE category IS NOT NULL")
def q_categories(spark, folder):
    return lookup.list_categories(sales(spark, folder, "category"))


@register("list_delegations", f"WITH {SALES} SELECT DISTINCT delegation FROM sales WHERE delegation IS NOT NULL")
def q_delegations(spark, folder):
    return lookup.list_delegations(sales(spark, folder, "delegation"))


@register("list_localities", f"WITH {SALES} SELECT DISTINCT locality FROM sales WHERE locality IS NOT NULL")
def q_localities(spark, folder):
    return lookup.list_localities(sales(spark, folder, "delegation", "locality"))


@register(
    "list_localities_of_delegation",
    f"WITH {SALES} SELECT DISTINCT locality FROM sales WHERE delegation = 'ASIA' AND locality IS NOT NULL",
)
def q_localities_of(spark, folder):
    return lookup.list_localities(sales(spark, folder, "delegation", "locality"), "ASIA")


@register(
    "location_dims",
    f"""WITH {SALES}, usable AS (SELECT * FROM sales
      WHERE category IS NOT NULL AND delegation IS NOT NULL AND total_price IS NOT NULL)
    SELECT DISTINCT 'category' AS kind, category AS value FROM usable
    UNION ALL SELECT DISTINCT 'region', delegation FROM usable""",
)
def q_location_dims(spark, folder):
    return lookup.location_dims(sales(spark, folder, "category", "delegation", "total_price"))


@register(
    "search_products",
    f"""WITH {SALES} SELECT DISTINCT product_name FROM sales WHERE contains(lower(product_name), 'ring')
    ORDER BY product_name LIMIT 20""",
)
def q_search(spark, folder):
    return lookup.search_products(sales(spark, folder, "product_name"), "RING")


@register(
    "filter_slice",
    f"""WITH {SALES} SELECT client_id, purchase_date, product_id, category, delegation, revenue FROM sales
    WHERE category = 'PROMO' AND delegation = 'EUROPE'""",
)
def q_filter_slice(spark, folder):
    columns = ["client_id", "purchase_date", "product_id", "category", "delegation", "revenue"]
    return lookup.filter_slice(sales(spark, folder, *columns), "PROMO", "EUROPE")


@register(
    "filter_product",
    f"""WITH {SALES} SELECT client_id, purchase_date, product_name, quantity FROM sales
    WHERE contains(lower(product_name), 'gizmo')""",
)
def q_filter_product(spark, folder):
    rows = sales(spark, folder, "client_id", "purchase_date", "product_name", "quantity")
    return lookup.filter_product(rows, "Gizmo")


@register(
    "filter_product_exact",
    f"""WITH {SALES} SELECT client_id, purchase_date, product_name, quantity FROM sales
    WHERE lower(product_name) = 'red ring'""",
)
def q_filter_product_exact(spark, folder):
    rows = sales(spark, folder, "client_id", "purchase_date", "product_name", "quantity")
    return lookup.filter_product(rows, "RED Ring", exact=True)


@register("customer_history", f"WITH {SALES} SELECT * FROM sales WHERE client_id = '7'")
def q_customer_history(spark, folder):
    return lookup.customer_history(sales(spark, folder), "7")


def name_queries(spark, folder):
    """Spellings made from every part name: upper case, beginning, one word, a middle piece, nonsense."""
    name = F.col("p_name")
    spellings = F.array(
        F.concat(F.lit(" "), F.upper(name)),
        F.substring(name, F.lit(1), F.length(name) - 2),
        F.concat(F.lit("grand "), F.split(name, " ")[1], F.lit(" "), F.split(name, " ")[1]),
        F.concat(F.split(name, " ")[1], F.lit("? "), F.split(name, " ")[0]),
        F.substring(name, F.lit(3), F.lit(5)),
        F.substring(name, F.lit(2), F.lit(3)),
        F.concat(F.lit("zz"), F.reverse(name)),
    )
    return table(spark, folder, "part").select(F.explode(spellings).alias("query")).distinct()


NAME_QUERIES = """queries AS (
  SELECT DISTINCT unnest([' ' || upper(p_name), substr(p_name, 1, length(p_name) - 2),
    'grand ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 2),
    split_part(p_name, ' ', 2) || '? ' || split_part(p_name, ' ', 1),
    substr(p_name, 3, 5), substr(p_name, 2, 3), 'zz' || reverse(p_name)]) AS query
  FROM part
)"""

MATCHES = """tokens AS (
  SELECT query, lower(trim(query)) AS q,
         regexp_extract_all(lower(trim(query)), '[\\p{L}\\p{N}_]+') AS q_words FROM queries
), names AS (
  SELECT DISTINCT product_name AS name, lower(product_name) AS low,
         regexp_extract_all(lower(product_name), '[\\p{L}\\p{N}_]+') AS words FROM sales
), scored AS (
  SELECT query, q, name, low, len([w for w in q_words if list_contains(words, w)]) AS shared
  FROM tokens CROSS JOIN names
), staged AS (
  SELECT query, name, CASE WHEN low = q THEN 1 WHEN starts_with(low, q) THEN 2 WHEN shared > 0 THEN 3
         WHEN length(q) >= 4 AND contains(low, q) THEN 4 END AS stage, shared FROM scored WHERE q <> ''
), best AS (
  SELECT query, name FROM staged WHERE stage IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query
    ORDER BY stage, CASE WHEN stage = 3 THEN -shared ELSE 0 END, name) = 1
)"""


@register(
    "match_product_name",
    f"""WITH {SALES}, {NAME_QUERIES}, {MATCHES}
    SELECT query, name AS matched FROM queries LEFT JOIN best USING (query)""",
)
def q_match_product_name(spark, folder):
    return lookup.match_product_name(name_queries(spark, folder), sales(spark, folder, "product_name"))


@register(
    "resolve_category",
    f"""WITH {SALES}, queries AS (
      SELECT DISTINCT unnest([p_type, lower(p_type), substr(p_type, 2, 3), 'rayon ' || p_type || ' 1', p_brand, '']) AS query
      FROM part
    ), known AS (SELECT DISTINCT category AS name FROM sales)
    SELECT query, CASE WHEN query = '' THEN (SELECT min(name) FROM known) ELSE coalesce(
      (SELECT min(name) FROM known WHERE name = query),
      (SELECT max(name) FROM known WHERE lower(name) = lower(query)),
      (SELECT min(name) FROM known WHERE contains(lower(name), lower(query)) OR contains(lower(query), lower(name))),
      query) END AS category
    FROM queries""",
)
def q_resolve_category(spark, folder):
    kind = F.col("p_type")
    spellings = F.array(
        kind, F.lower(kind), F.substring(kind, 2, 3),
        F.concat(F.lit("rayon "), kind, F.lit(" 1")), F.col("p_brand"), F.lit(""),
    )
    queries = table(spark, folder, "part").select(F.explode(spellings).alias("query")).distinct()
    return lookup.resolve_category(queries, sales(spark, folder, "category"))
