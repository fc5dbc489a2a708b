from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emporia.operators import basket, rules
from emporia.plans.registry import r, register, texts, tidy
from emporia.plans.views import BASKETS, SALES
from emporia.schema import BASKET_KEYS
from emporia.sources.star import sales, table
from emporia.sources.store import shared_dir

ITEM_COLUMNS = ["client_id", "purchase_date", "product_name"]


def purchases(spark, folder, *more):
    return sales(spark, folder, *ITEM_COLUMNS, *more)


def baskets(spark, folder):
    return basket.basket_table(basket.item_rows(purchases(spark, folder)))


@register("basket_items", f"WITH {SALES}, {BASKETS} SELECT * FROM items")
def q_basket_items(spark, folder):
    return basket.basket_items(purchases(spark, folder))


@register("item_support", f"WITH {SALES}, {BASKETS} SELECT item, support, n FROM support CROSS JOIN n")
def q_item_support(spark, folder):
    return basket.item_support(baskets(spark, folder))


@register("pair_counts", f"WITH {SALES}, {BASKETS} SELECT * FROM pairs")
def q_pair_counts(spark, folder):
    return basket.pair_counts(baskets(spark, folder))


@register("top_pairs", f"WITH {SALES}, {BASKETS} SELECT * FROM pairs ORDER BY frequency DESC, x, y LIMIT 5")
def q_top_pairs(spark, folder):
    return basket.top_pairs(purchases(spark, folder))


def sliced(category: str, delegation: str) -> str:
    return SALES.replace("sales AS (", "everything AS (", 1) + (
        f", sales AS (SELECT * FROM everything WHERE category = '{category}' AND delegation = '{delegation}')"
    )


@register(
    "top_pairs_in_slice",
    f"WITH {sliced('PROMO', 'ASIA')}, {BASKETS} SELECT * FROM pairs ORDER BY frequency DESC, x, y LIMIT 7",
)
def q_top_pairs_in_slice(spark, folder):
    return basket.top_pairs(purchases(spark, folder, "category", "delegation"), "PROMO", "ASIA", 7)


PAIR_METRICS_SQL = f"""WITH {SALES}, {BASKETS} SELECT x, y, frequency, support_x, support_y, n, {r('confidence')} AS confidence,
    {r('expected')} AS expected, {r('lift')} AS lift FROM metrics"""


@register("pair_metrics", PAIR_METRICS_SQL)
def q_pair_metrics(spark, folder):
    return tidy(basket.pair_metrics(purchases(spark, folder)))


@register("saved_basket_tables", PAIR_METRICS_SQL)
def q_saved_basket_tables(spark, folder):
    """The same from supports and pair counts that were saved and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/emporia/baskets-{uuid.uuid4().hex}"
    basket.save_basket_tables(purchases(spark, folder), path)
    return tidy(basket.load_basket_tables(spark, path))


PLACED = f"""placed AS (
  SELECT x, y, frequency, {r('confidence', 1)} AS confidence, {r('lift', 2)} AS lift,
    {r('CASE WHEN lift >= 1 THEN confidence * lift * ln(1 + frequency) ELSE confidence * lift END', 2)} AS score,
    CASE WHEN lift >= 1.5 AND confidence >= 10 THEN 'a_eloigner'
         WHEN lift < 0.8 OR (lift < 1 AND confidence < 5) THEN 'a_rapprocher'
         ELSE 'neutres' END AS class
  FROM metrics
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY class
    ORDER BY CASE WHEN class = 'a_eloigner' THEN -lift ELSE lift END, x, y) AS INTEGER) AS rank
  FROM placed
)"""


@register("placement", f"WITH {SALES}, {BASKETS}, {PLACED} SELECT * FROM ranked WHERE rank <= 10")
def q_placement(spark, folder):
    """All three classes, since the test tables hold no pair to keep apart at larger scales."""
    return basket.placement(purchases(spark, folder), with_neutral=True)


@register(
    "placement_in_slice",
    f"""WITH {sliced('PROMO', 'ASIA')}, {BASKETS}, {PLACED}
    SELECT * FROM ranked WHERE rank <= 20 AND class <> 'neutres'""",
)
def q_placement_in_slice(spark, folder):
    fact = purchases(spark, folder, "category", "delegation")
    return basket.placement(fact, "PROMO", "ASIA", 20)


@register(
    "placement_tips",
    f"""WITH {SALES}, {BASKETS}, {PLACED} SELECT class, string_agg(x || ' + ' || y, ', ' ORDER BY rank) AS products
    FROM ranked WHERE rank <= 3 AND class <> 'neutres' GROUP BY 1""",
)
def q_placement_tips(spark, folder):
    return basket.placement_tips(basket.placement(purchases(spark, folder)))


LAYOUT = f"""sets AS (
  SELECT client_id, purchase_date, list_sort(list(DISTINCT category)) AS cats FROM sales
  WHERE category IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT category) >= 2
), held AS (
  SELECT client_id, purchase_date, unnest(cats) AS cat FROM sets
), support AS (
  SELECT cat, count(*) AS support FROM held GROUP BY 1
), pairs AS (
  SELECT a.cat AS x, b.cat AS y, count(*) AS frequency FROM held a JOIN held b
    ON a.client_id = b.client_id AND a.purchase_date = b.purchase_date AND a.cat < b.cat GROUP BY 1, 2
), metrics AS (
  SELECT x, y, frequency, frequency / sx.support * 100 AS confidence,
         frequency / (CAST(sx.support AS DOUBLE) * sy.support / (SELECT count(*) FROM sets)) AS lift
  FROM pairs JOIN support sx ON sx.cat = x JOIN support sy ON sy.cat = y
), classed AS (
  SELECT *, CASE WHEN lift >= 1.1 AND confidence >= 5 THEN 'a_eloigner' ELSE 'a_rapprocher' END AS class,
    CASE WHEN lift >= 1.1 AND confidence >= 5 THEN 'positive'
         WHEN lift < 0.9 OR confidence < 3 THEN 'negative' ELSE 'neutral' END AS association
  FROM metrics
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY class
    ORDER BY CASE WHEN class = 'a_eloigner' THEN -lift ELSE lift END, x, y) AS INTEGER) AS rank
  FROM classed QUALIFY rank <= 10
)"""


@register(
    "layout",
    f"""WITH {SALES}, {LAYOUT} SELECT x, y, frequency, {r('confidence')} AS confidence, {r('lift')} AS lift, class,
    association, rank FROM ranked""",
)
def q_layout(spark, folder):
    return tidy(basket.layout(sales(spark, folder, *BASKET_KEYS, "category")))


@register(
    "layout_action",
    f"""WITH {SALES}, {LAYOUT} SELECT x, y, {r('lift')} AS lift, CASE WHEN lift < 0.85 THEN 'À rapprocher'
    WHEN lift < 0.95 THEN 'Placement libre' ELSE 'À éloigner' END AS action FROM ranked""",
)
def q_layout_action(spark, folder):
    return tidy(basket.layout_action(basket.layout(sales(spark, folder, *BASKET_KEYS, "category"))))


def neighbouring_parts(spark, folder):
    """Each part's name in capitals with the next part's name; every 100th has an unknown partner."""
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return part.join(following, "p_partkey").select(
        F.upper("p_name").alias("product_1"),
        F.when(F.col("p_partkey") % 100 == 0, "zzz").otherwise(F.col("next")).alias("product_2"),
    )


ANALYZED = f"""asked AS (
  SELECT DISTINCT upper(a.p_name) AS product_1, CASE WHEN a.p_partkey % 100 = 0 THEN 'zzz' ELSE b.p_name END AS product_2
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
), resolved AS (
  SELECT product_1, product_2,
    (SELECT min(product_name) FROM sales WHERE lower(product_name) = lower(product_1)) AS matched_1,
    (SELECT min(product_name) FROM sales WHERE lower(product_name) = lower(product_2)) AS matched_2
  FROM asked
), counted AS (
  SELECT r.*, matched_1 IS NOT NULL AND matched_2 IS NOT NULL AS known, s1.support AS s1, s2.support AS s2,
    CASE WHEN matched_1 = matched_2 THEN s1.support ELSE p.frequency END AS f
  FROM resolved r LEFT JOIN support s1 ON s1.item = matched_1 LEFT JOIN support s2 ON s2.item = matched_2
  LEFT JOIN pairs p ON p.x = least(matched_1, matched_2) AND p.y = greatest(matched_1, matched_2)
), zeroed AS (
  SELECT product_1, product_2, matched_1, matched_2,
    CASE WHEN known THEN coalesce(s1, 0) ELSE 0 END AS support_1,
    CASE WHEN known THEN coalesce(s2, 0) ELSE 0 END AS support_2,
    CASE WHEN known THEN coalesce(f, 0) ELSE 0 END AS frequency, n AS basket_count,
    concat_ws(', ', CASE WHEN matched_1 IS NULL THEN product_1 END, CASE WHEN matched_2 IS NULL THEN product_2 END) AS missing
  FROM counted CROSS JOIN n
), measured AS (
  SELECT *, coalesce({r('frequency / nullif(support_1, 0) * 100', 1)}, 0) AS confidence,
    coalesce({r('frequency / nullif(support_2, 0) * 100', 1)}, 0) AS confidence_reverse,
    coalesce({r('frequency / nullif(CAST(support_1 AS DOUBLE) * support_2 / basket_count, 0)', 2)}, 0) AS lift
  FROM zeroed
), scored AS (
  SELECT *, {r('''CASE WHEN lift >= 1 THEN greatest(confidence, confidence_reverse) * lift * ln(1 + frequency)
    ELSE greatest(confidence, confidence_reverse) * lift END''', 2)} AS score FROM measured
), tiered AS (
  SELECT *, CASE WHEN missing <> '' THEN 'unknown' WHEN score >= 50 THEN 'strong' WHEN score >= 20 THEN 'often'
    WHEN score >= 5 THEN 'moderate' WHEN lift >= 1 AND frequency > 0 THEN 'weak' ELSE 'none' END AS tier
  FROM scored
)"""


@register(
    "analyze_pairs",
    f"WITH {SALES}, {BASKETS}, {ANALYZED} SELECT *, tier IN ('strong', 'often') AS together FROM tiered",
)
def q_analyze_pairs(spark, folder):
    return basket.analyze_pairs(purchases(spark, folder), neighbouring_parts(spark, folder))


@register(
    "related_products",
    f"""WITH {SALES}, {BASKETS}, both_ways AS (
      SELECT x AS product, y AS neighbour, frequency, support_x AS support, lift FROM metrics
      UNION ALL SELECT y, x, frequency, support_y, lift FROM metrics
    ), rated AS (
      SELECT product, neighbour, frequency, support, {r('frequency / support * 100', 1)} AS confidence,
        {r('lift', 2)} AS lift FROM both_ways
    ), kept AS (
      SELECT *, max(CASE WHEN confidence >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY product) AS has FROM rated
    )
    SELECT product, neighbour, frequency, support, confidence, lift, CAST(row_number() OVER (
      PARTITION BY product ORDER BY lift DESC, neighbour) AS INTEGER) AS rank
    FROM kept WHERE has = 0 OR confidence >= 5 QUALIFY rank <= 5""",
)
def q_related_products(spark, folder):
    return basket.related_products(basket.pair_metrics(purchases(spark, folder)))


PRESENCE = """SELECT {key}, product_name AS item, sum(quantity) > 0 AS present FROM sales
  WHERE {key} IS NOT NULL AND product_name IS NOT NULL GROUP BY 1, 2"""


def baskets_sql(key: str) -> str:
    return f"""WITH {SALES}, cells AS ({PRESENCE.format(key=key)})
    SELECT {key}, coalesce(string_agg(item, '|' ORDER BY item) FILTER (present), '') AS items FROM cells GROUP BY 1"""


@register("baskets_by_client", baskets_sql("client_id"))
def q_baskets_by_client(spark, folder):
    return texts(rules.baskets_by_client(sales(spark, folder, "client_id", "product_name", "quantity")), "items")


@register("baskets_by_date", baskets_sql("purchase_date"))
def q_baskets_by_date(spark, folder):
    return texts(rules.baskets_by_date(sales(spark, folder, "purchase_date", "product_name", "quantity")), "items")


@register(
    "cap_matrix",
    f"""WITH {SALES}, cells AS ({PRESENCE.format(key='client_id')})
    SELECT client_id, item, present FROM cells
    WHERE client_id IN (SELECT DISTINCT client_id FROM cells ORDER BY 1 LIMIT 1000)
      AND item IN (SELECT DISTINCT item FROM cells ORDER BY 1 LIMIT 30)""",
)
def q_cap_matrix(spark, folder):
    fact = sales(spark, folder, "client_id", "product_name", "quantity")
    whole = rules.presence(fact, ["client_id"])
    return rules.cap_matrix(whole, "client_id", rules.MATRIX_BASKETS, rules.MATRIX_ITEMS)


# Itemsets over categories by bit masks, any length.
CATEGORY_SETS = f"""levels AS (
  SELECT category, row_number() OVER (ORDER BY category) - 1 AS bit FROM (SELECT DISTINCT category FROM sales)
), masks AS (
  SELECT client_id, purchase_date, CAST(sum(1 << bit) AS BIGINT) AS held
  FROM (SELECT client_id, purchase_date, category FROM sales GROUP BY 1, 2, 3 HAVING sum(quantity) > 0)
  JOIN levels USING (category) GROUP BY 1, 2
), weighted AS (
  SELECT held, count(*) AS w FROM masks GROUP BY 1
), total AS (
  SELECT count(*) AS n FROM (SELECT DISTINCT client_id, purchase_date FROM sales)
), candidates AS (
  SELECT unnest(range(1, CAST(1 << (SELECT count(*) FROM levels) AS BIGINT))) AS mask
), frequent AS (
  SELECT mask, CAST(sum(w) AS BIGINT) AS c, n FROM candidates JOIN weighted ON held & mask = mask CROSS JOIN total
  GROUP BY mask, n HAVING sum(w) >= 0.02 * n
), labelled AS (
  SELECT mask, c, n, string_agg(category, '|' ORDER BY category) AS items
  FROM frequent JOIN levels ON (mask >> bit) & 1 = 1 GROUP BY 1, 2, 3
)"""

CATEGORY_ITEMSETS_SQL = f"""WITH {SALES}, {CATEGORY_SETS}
    SELECT items, c AS count, n, {r('c / n', 6)} AS support FROM labelled"""


def category_matrix(spark, folder):
    fact = sales(spark, folder, *BASKET_KEYS, "category", "quantity")
    return rules.presence(fact, BASKET_KEYS, "category")


@register("frequent_itemsets", CATEGORY_ITEMSETS_SQL)
def q_frequent_itemsets(spark, folder):
    """Categories bought together by one client on one day, any length."""
    return tidy(texts(rules.frequent_itemsets(category_matrix(spark, folder)), "items"), 6)


@register("fp_itemsets", CATEGORY_ITEMSETS_SQL)
def q_fp_itemsets(spark, folder):
    fact = sales(spark, folder, *BASKET_KEYS, "category", "quantity")
    baskets = rules.baskets_by(fact, BASKET_KEYS, "category")
    return tidy(texts(rules.fp_itemsets(baskets), "items"), 6)


def metrics_sql(joint: str, left: str, right: str, n: str = "n") -> str:
    return f"""{r(f'{left} / {n}', 6)} AS antecedent_support, {r(f'{right} / {n}', 6)} AS consequent_support,
      {r(f'{joint} / {n}', 6)} AS support, {r(f'{joint} / {left}', 6)} AS confidence,
      {r(f'CAST({joint} AS DOUBLE) * {n} / (CAST({left} AS DOUBLE) * {right})', 6)} AS lift,
      {r(f'{joint} / {n} - ({left} / {n}) * ({right} / {n})', 6)} AS leverage,
      CASE WHEN {joint} = {left} THEN CAST('inf' AS DOUBLE)
        ELSE {r(f'(1 - {right} / {n}) / nullif(1 - {joint} / {left}, 0)', 6)} END AS conviction"""


@register(
    "association_rules",
    f"""WITH {SALES}, {CATEGORY_SETS}
    SELECT a.items AS antecedents, b.items AS consequents, {metrics_sql('j.c', 'a.c', 'b.c', 'j.n')}
    FROM labelled j JOIN labelled a ON a.mask & j.mask = a.mask AND a.mask <> j.mask
    JOIN labelled b ON b.mask = xor(j.mask, a.mask)
    WHERE CAST(j.c AS DOUBLE) * j.n >= CAST(a.c AS DOUBLE) * b.c""",
)
def q_association_rules(spark, folder):
    itemsets = rules.frequent_itemsets(category_matrix(spark, folder))
    return tidy(texts(rules.association_rules(itemsets), "antecedents", "consequents"), 6)


def item_sets(keys: str, min_support: str, item: str = "product_name") -> str:
    """Itemsets of any length: per basket, sets grow by later items as long as they are frequent."""
    on = " AND ".join(f"l.{k} = k.{k}" for k in keys.split(", "))
    own = ", ".join(f"k.{k}" for k in keys.split(", "))
    return f"""held AS (
      SELECT {keys}, {item} AS item FROM sales GROUP BY ALL HAVING sum(quantity) > 0
    ), total AS (
      SELECT count(*) AS n FROM (SELECT DISTINCT {keys} FROM sales)
    ), kept AS (
      SELECT * FROM held WHERE item IN (
        SELECT item FROM held GROUP BY 1 HAVING count(*) >= {min_support} * (SELECT n FROM total))
    ), lattice AS (
      SELECT [item] AS items, {keys} FROM kept
      UNION ALL
      SELECT * FROM (
        SELECT list_append(l.items, k.item) AS items, {own} FROM lattice l JOIN kept k ON {on} AND k.item > l.items[-1]
      ) QUALIFY count(*) OVER (PARTITION BY items) >= {min_support} * (SELECT n FROM total)
    ), itemsets AS (
      SELECT items, count(*) AS c FROM lattice GROUP BY 1
    )"""


def name_matrix(spark, folder, keys):
    return rules.presence(sales(spark, folder, *keys, "product_name", "quantity"), keys)


@register(
    "frequent_itemsets_names",
    f"""WITH RECURSIVE {SALES}, {item_sets('client_id, purchase_date', '0.002')}
    SELECT array_to_string(items, '|') AS items, c AS count, n, {r('c / n', 6)} AS support
    FROM itemsets CROSS JOIN total""",
)
def q_frequent_itemsets_names(spark, folder):
    matrix = name_matrix(spark, folder, BASKET_KEYS)
    itemsets = rules.frequent_itemsets(matrix, min_support=0.002)
    return tidy(texts(itemsets, "items"), 6)


RULE_SPLITS = """splits AS (
      SELECT items, c AS joint, [items[i] for i in range(1, len(items) + 1) if (mask >> (i - 1)) & 1 = 1] AS antecedents,
             [items[i] for i in range(1, len(items) + 1) if (mask >> (i - 1)) & 1 = 0] AS consequents
      FROM (SELECT items, c, unnest(range(1, CAST((1 << len(items)) - 1 AS BIGINT))) AS mask FROM itemsets WHERE len(items) >= 2)
    ), rules AS (
      SELECT s.antecedents, s.consequents, s.joint, a.c AS ca, b.c AS cb, n
      FROM splits s JOIN itemsets a ON a.items = s.antecedents JOIN itemsets b ON b.items = s.consequents CROSS JOIN total
      WHERE CAST(s.joint AS DOUBLE) * n >= CAST(a.c AS DOUBLE) * b.c
    )"""


@register(
    "association_rules_names",
    f"""WITH RECURSIVE {SALES}, {item_sets('client_id, purchase_date', '0.002')}, {RULE_SPLITS}
    SELECT array_to_string(antecedents, '|') AS antecedents, array_to_string(consequents, '|') AS consequents,
      {metrics_sql('joint', 'ca', 'cb')} FROM rules""",
)
def q_association_rules_names(spark, folder):
    matrix = name_matrix(spark, folder, BASKET_KEYS)
    itemsets = rules.frequent_itemsets(matrix, min_support=0.002)
    return tidy(texts(rules.association_rules(itemsets), "antecedents", "consequents"), 6)


@register(
    "bundles",
    f"""WITH RECURSIVE {SALES}, {item_sets('purchase_date', '0.02', 'category')}, {RULE_SPLITS}
    SELECT array_to_string(antecedents, '|') AS items, array_to_string(consequents, '|') AS recommended,
      {r('joint / ca', 6)} AS confidence, {r('CAST(joint AS DOUBLE) * n / (CAST(ca AS DOUBLE) * cb)', 6)} AS lift
    FROM rules ORDER BY CAST(joint AS DOUBLE) * n / (CAST(ca AS DOUBLE) * cb) DESC, joint / n DESC, antecedents, consequents
    LIMIT 10""",
)
def q_bundles(spark, folder):
    """Categories sold on one day, any length."""
    fact = sales(spark, folder, "purchase_date", "category", "quantity")
    itemsets = rules.frequent_itemsets(rules.presence(fact, ["purchase_date"], "category"), ["purchase_date"])
    return tidy(texts(rules.bundles(rules.association_rules(itemsets)), "items", "recommended"), 6)
