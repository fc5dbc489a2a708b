from __future__ import annotations

from pyspark.sql import functions as F

from emporia.operators import questions as q
from emporia.plans.baskets import ANALYZED
from emporia.plans.registry import register, texts
from emporia.plans.views import BASKETS, SALES
from emporia.sources.star import sales, table
from emporia.sources.store import work_table

DIMENSIONS = ["category", "delegation"]


def questions(spark, folder):
    """Every user turn, with a business question about a part and regions added to its text."""
    last = table(spark, folder, "part").agg(F.count("*") - 1).scalar()
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("pick"), F.col("p_name").alias("name"), F.col("p_type").alias("kind")
    )
    partner = part.select((F.col("pick") - 1).alias("pick"), F.col("name").alias("other"))
    region = table(spark, folder, "region")
    first = region.select(F.col("r_regionkey").cast("bigint").alias("k1"), F.col("r_name").alias("here"))
    second = region.select(F.col("r_regionkey").cast("bigint").alias("k2"), F.col("r_name").alias("there"))
    form = (F.col("conv_id") + F.floor(F.col("turn") / 2)) % 10
    pieces = [
        ("Quel est le produit le plus acheté à ", F.initcap("here"), ""),
        ("Top 3 produits dans ", F.lower("kind"), ""),
        ("Compare les ventes de ", F.col("here"), " et de ", F.col("there")),
        ("Et a ", F.lower("there"), " c est les memes ?"),
        ("Quels produits sont achetés ensemble à ", F.col("here"), ", top 4"),
        ('Analyse "', F.col("name"), "\" avec '", F.col("other"), "'"),
        ("Quelles sont les catégories ?",),
        ("dashboard",),
        ("",),
        ("", F.col("there")),
    ]
    added = F.lit("")
    for number, piece in enumerate(pieces):
        parts = [p if not isinstance(p, str) else F.lit(p) for p in piece]
        added = F.when(form == number, F.concat(*parts)).otherwise(added)
    turns = table(spark, folder, "conversations").where("role = 'user'")
    return (
        turns.withColumn("pick", F.col("conv_id") % last)
        .withColumn("k1", F.col("conv_id") % 5)
        .withColumn("k2", (F.col("conv_id") + F.col("turn")) % 5)
        .join(part, "pick").join(partner, "pick").join(first, "k1").join(second, "k2")
        .select("conv_id", "turn", F.concat("text", F.lit(" "), added).alias("text"))
    )


QUESTIONS = """questions AS (
  SELECT conv_id, turn, c.text || ' ' || CASE (conv_id + CAST(floor(turn / 2) AS BIGINT)) % 10
      WHEN 0 THEN 'Quel est le produit le plus acheté à ' || array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(h.r_name, ' ')], ' ')
      WHEN 1 THEN 'Top 3 produits dans ' || lower(p.p_type)
      WHEN 2 THEN 'Compare les ventes de ' || h.r_name || ' et de ' || t.r_name
      WHEN 3 THEN 'Et a ' || lower(t.r_name) || ' c est les memes ?'
      WHEN 4 THEN 'Quels produits sont achetés ensemble à ' || h.r_name || ', top 4'
      WHEN 5 THEN 'Analyse "' || p.p_name || '" avec ''' || o.p_name || ''''
      WHEN 6 THEN 'Quelles sont les catégories ?'
      WHEN 7 THEN 'dashboard' WHEN 8 THEN '' WHEN 9 THEN t.r_name END AS text
  FROM conversations c JOIN part p ON p.p_partkey = conv_id % (SELECT count(*) - 1 FROM part)
  JOIN part o ON o.p_partkey = p.p_partkey + 1
  JOIN region h ON h.r_regionkey = conv_id % 5 JOIN region t ON t.r_regionkey = (conv_id + turn) % 5
  WHERE role = 'user'
)"""


def any_of(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


COMPARISON, FOLLOW_UP, SINGLE = any_of(q.COMPARISON_WORDS), any_of(q.FOLLOW_UP_WORDS), any_of(q.SINGLE_WORDS)
TOP, BASKET, CATEGORY = any_of(q.TOP_WORDS), any_of(q.BASKET_WORDS), any_of(q.CATEGORY_WORDS)
INSIGHT = any_of(q.INSIGHT_WORDS)

FILTERED = f"""{QUESTIONS}, lowered AS (
  SELECT *, lower(text) AS low, regexp_extract(lower(text), 'top (\\d+)', 1) AS num FROM questions
), filters AS (
  SELECT conv_id, turn, text, low, {COMPARISON} AS is_comparison,
    CASE WHEN num <> '' THEN CAST(num AS BIGINT) WHEN {SINGLE} THEN 1 ELSE 5 END AS top_n,
    {SINGLE} OR num = '1' AS single_product,
    [s[2:-2] for s in regexp_extract_all(text, '"[^"]+"|''[^'']+''')] AS products,
    [c for c in (SELECT list(DISTINCT category ORDER BY category) FROM sales) if contains(low, lower(c))] AS cats,
    [d for d in (SELECT list(DISTINCT delegation ORDER BY delegation) FROM sales) if contains(low, lower(d))] AS regions
  FROM lowered
), named AS (
  SELECT *, cats[1] AS category, regions[-1] AS delegation, len(regions) AS k FROM filters
)"""


def filtered(spark, folder):
    dims = work_table(sales(spark, folder, *DIMENSIONS).distinct())
    return q.extract_filters(questions(spark, folder), dims, dims), dims


@register(
    "extract_filters",
    f"""WITH {SALES}, {FILTERED} SELECT conv_id, turn, is_comparison, top_n, single_product,
    array_to_string(products, '|') AS products, array_to_string(regions, '|') AS regions, category, delegation FROM named""",
)
def q_extract_filters(spark, folder):
    return texts(filtered(spark, folder)[0].drop("text", "text_low"), "products", "regions")


ROUTED = f"""{FILTERED}, based AS (
  SELECT *, CASE WHEN is_comparison AND NOT {FOLLOW_UP} AND k >= 2 THEN 'comparison'
      WHEN {BASKET} THEN 'basket' WHEN {TOP} THEN 'top_products' WHEN {CATEGORY} THEN 'categories'
      WHEN NOT {FOLLOW_UP} AND k >= 2 THEN 'comparison'
      WHEN category IS NOT NULL OR k > 0 THEN 'top_products'
      WHEN {INSIGHT} THEN 'insights' ELSE 'general' END AS base
  FROM named
), setting AS (
  SELECT *, CASE WHEN base = 'top_products' AND top_n > 0 AND (category IS NULL OR EXISTS (
      SELECT 1 FROM sales s WHERE s.category = based.category AND s.delegation = based.delegation)) THEN delegation END AS could
  FROM based
), contexts AS (
  SELECT *, {FOLLOW_UP} AND k = 1 AND count(could) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS follows
  FROM setting
), routed AS (
  SELECT *, CASE WHEN follows THEN 'comparison' ELSE base END AS intent,
    CASE WHEN follows THEN last_value(CASE WHEN NOT follows THEN could END IGNORE NULLS) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS previous_region
  FROM contexts
)"""


def routed(spark, folder):
    found, dims = filtered(spark, folder)
    return work_table(q.route_questions(found, dims))


@register(
    "route_questions",
    f"WITH {SALES}, {ROUTED} SELECT conv_id, turn, intent, previous_region FROM routed",
)
def q_route_questions(spark, folder):
    return routed(spark, folder).select("conv_id", "turn", "intent", "previous_region")


@register(
    "answer_top_products",
    f"""WITH {SALES}, {ROUTED}, asked AS (SELECT * FROM routed WHERE intent = 'top_products'), counts AS (
      SELECT a.conv_id, a.turn, CASE WHEN a.single_product THEN least(a.top_n, 1) ELSE a.top_n END AS n,
        s.product_name, count(*) AS row_count FROM asked a
      JOIN sales s ON (a.category IS NULL OR s.category = a.category) AND (a.delegation IS NULL OR s.delegation = a.delegation)
      GROUP BY 1, 2, 3, 4), listed AS (
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY row_count DESC, product_name)
      AS INTEGER) AS rank, product_name, row_count FROM counts QUALIFY rank <= n)
    SELECT conv_id, turn, rank, product_name, row_count,
      CASE WHEN rank IS NULL THEN 'no product' ELSE 'found' END AS status
    FROM asked LEFT JOIN listed USING (conv_id, turn)""",
)
def q_answer_top_products(spark, folder):
    fact = sales(spark, folder, *DIMENSIONS, "product_name")
    return q.answer_top_products(routed(spark, folder), fact)


@register(
    "answer_comparisons",
    f"""WITH {SALES}, {ROUTED}, sides AS (
      SELECT conv_id, turn, 1 AS side, coalesce(previous_region, regions[1]) AS region,
        CASE WHEN previous_region IS NULL THEN 5 ELSE 3 END AS n FROM routed WHERE intent = 'comparison'
      UNION ALL SELECT conv_id, turn, 2, CASE WHEN previous_region IS NULL THEN regions[2] ELSE regions[1] END,
        CASE WHEN previous_region IS NULL THEN 5 ELSE 3 END FROM routed WHERE intent = 'comparison'
    ), top AS (
      SELECT delegation, product_name, count(*) AS row_count, row_number() OVER (
        PARTITION BY delegation ORDER BY count(*) DESC, product_name) AS rank FROM sales GROUP BY 1, 2
    ), listed AS (
      SELECT conv_id, turn, side, region, rank, product_name, row_count FROM sides
      JOIN top ON delegation = region AND rank <= n)
    SELECT conv_id, turn, CAST(side AS INTEGER) AS side, region, CAST(rank AS INTEGER) AS rank, product_name, row_count,
      count(*) OVER (PARTITION BY conv_id, turn, product_name) = 2 AS common FROM listed""",
)
def q_answer_comparisons(spark, folder):
    return q.answer_comparisons(routed(spark, folder), sales(spark, folder, "delegation", "product_name"))


ASKED_PAIRS = ANALYZED[ANALYZED.index("), resolved AS ("):]


@register(
    "answer_pairs",
    f"""WITH {SALES}, {ROUTED}, {BASKETS}, about AS (
      SELECT conv_id, turn, products[1] AS product_1, products[2] AS product_2 FROM routed
      WHERE intent = 'basket' AND len(products) >= 2
    ), asked AS (SELECT DISTINCT product_1, product_2 FROM about {ASKED_PAIRS}, slices AS (
      SELECT conv_id, turn, top_n, category, delegation FROM routed WHERE intent = 'basket' AND len(products) < 2
    ), distinct_slices AS (SELECT DISTINCT category, delegation FROM slices), slice_items AS (
      SELECT DISTINCT d.category AS c, d.delegation AS d, client_id, purchase_date, product_name AS item
      FROM distinct_slices d JOIN sales s
        ON (d.category IS NULL OR s.category = d.category) AND (d.delegation IS NULL OR s.delegation = d.delegation)
    ), slice_pairs AS (
      SELECT a.c, a.d, a.item AS x, b.item AS y, count(*) AS frequency,
        row_number() OVER (PARTITION BY a.c, a.d ORDER BY count(*) DESC, a.item, b.item) AS rank
      FROM slice_items a JOIN slice_items b ON a.c IS NOT DISTINCT FROM b.c AND a.d IS NOT DISTINCT FROM b.d
        AND a.client_id = b.client_id AND a.purchase_date = b.purchase_date AND a.item < b.item GROUP BY 1, 2, 3, 4)
    SELECT conv_id, turn, 1 AS rank, coalesce(matched_1, product_1) AS product_1,
      coalesce(matched_2, product_2) AS product_2, frequency, confidence, tier, 'found' AS status
    FROM about JOIN tiered USING (product_1, product_2)
    UNION ALL SELECT conv_id, turn, CAST(rank AS INTEGER), x, y, frequency, NULL, NULL,
      CASE WHEN rank IS NULL THEN 'no pair' ELSE 'found' END
    FROM slices LEFT JOIN slice_pairs
      ON c IS NOT DISTINCT FROM category AND d IS NOT DISTINCT FROM delegation AND rank <= top_n""",
)
def q_answer_pairs(spark, folder):
    fact = sales(spark, folder, *DIMENSIONS, "client_id", "purchase_date", "product_name")
    return q.answer_pairs(routed(spark, folder), fact)
