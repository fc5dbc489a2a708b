"""SQL for the views the SQL twins start from."""

from __future__ import annotations

SALES = """sales AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS client_id, CAST(o.o_orderdate AS DATE) AS purchase_date,
         CAST(l.l_partkey AS VARCHAR) AS product_id, p.p_name AS product_name, p.p_brand AS brand,
         p.p_type AS category, rg.r_name AS delegation, n.n_name AS locality,
         l.l_quantity AS quantity, p.p_retailprice AS unit_price, l.l_extendedprice AS total_price,
         l.l_quantity * p.p_retailprice AS revenue
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region rg ON rg.r_regionkey = n.n_regionkey
)"""

DIRTY = f"""{SALES}, copied AS (
  SELECT s.*, CAST(client_id AS BIGINT) AS ck, CAST(product_id AS BIGINT) AS pk FROM sales s
), doubled AS (
  SELECT * FROM copied UNION ALL SELECT * FROM copied WHERE ck % 10 = 0
), dirty AS (
  SELECT CASE WHEN ck % 83 = 0 THEN NULL ELSE ' ' || client_id || ' ' END AS client_id,
         CASE WHEN ck % 71 = 0 THEN 'n/d' ELSE strftime(purchase_date, '%d/%m/%Y') END AS purchase_date,
         product_id, '  ' || upper(product_name) || ' ' AS product_name,
         CASE WHEN pk % 40 = 0 THEN ' N/A ' ELSE brand END AS brand, category,
         CASE WHEN ck % 50 = 0 THEN NULL ELSE delegation END AS delegation, locality,
         CAST(quantity AS VARCHAR) AS quantity,
         CASE WHEN pk % 67 = 0 THEN '0' ELSE CAST(unit_price AS VARCHAR) END AS unit_price,
         CASE WHEN ck % 61 = 0 THEN 'abc' WHEN ck % 59 = 0 THEN '-1'
              ELSE CAST(total_price AS VARCHAR) END AS total_price
  FROM doubled
)"""

COERCED = f"""{DIRTY}, coerced AS (
  SELECT client_id, CAST(try_strptime(purchase_date, '%d/%m/%Y') AS DATE) AS purchase_date, product_id,
         product_name, brand, category, delegation, locality,
         TRY_CAST(quantity AS DOUBLE) AS quantity, TRY_CAST(unit_price AS DOUBLE) AS unit_price,
         TRY_CAST(total_price AS DOUBLE) AS total_price
  FROM dirty
)"""

VALID = f"""{COERCED}, valid AS (
  SELECT * FROM coerced
  WHERE client_id IS NOT NULL AND purchase_date IS NOT NULL AND quantity IS NOT NULL
    AND total_price > 0 AND unit_price > 0
)"""

NORMAL = f"""{VALID}, normal AS (
  SELECT trim(client_id) AS client_id, purchase_date, product_id, lower(trim(product_name)) AS product_name,
         lower(trim(brand)) AS brand, lower(trim(category)) AS category, delegation, locality, quantity,
         unit_price, total_price
  FROM valid
)"""

NAMED = f"""{NORMAL}, named AS (
  SELECT * FROM normal
  WHERE product_name NOT IN ('nan', 'none', '', 'unknown', 'inconnu', 'n/a', 'na')
    AND brand NOT IN ('nan', 'none', '', 'unknown', 'inconnu', 'n/a', 'na')
    AND category NOT IN ('nan', 'none', '', 'unknown', 'inconnu', 'n/a', 'na')
)"""

FACT = f"""{NAMED}, single AS (
  SELECT * FROM named
  QUALIFY row_number() OVER (
    PARTITION BY client_id, purchase_date, product_id, total_price, quantity
    ORDER BY product_name, brand, category, delegation NULLS FIRST, locality NULLS FIRST, unit_price
  ) = 1
), fact AS (
  SELECT *, quantity * unit_price AS revenue FROM single
), dim AS (
  SELECT product_id, product_name, brand, category FROM fact
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY product_name, brand, category) = 1
)"""

MONTHLY = """sums AS (
  SELECT product_name AS series_key, CAST(date_trunc('month', purchase_date) AS DATE) AS ds,
         sum(revenue) AS y, sum(quantity) AS q
  FROM sales GROUP BY 1, 2
), spans AS (
  SELECT series_key, unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS ds FROM sums GROUP BY 1
), series AS (
  SELECT p.series_key, CAST(p.ds AS DATE) AS ds, coalesce(s.y, 0) AS y, coalesce(s.q, 0) AS q
  FROM spans p LEFT JOIN sums s ON s.series_key = p.series_key AND s.ds = CAST(p.ds AS DATE)
)"""

BASKETS = """items AS (
  SELECT DISTINCT client_id, purchase_date, trim(product_name) AS item FROM sales WHERE trim(product_name) <> ''
), n AS (
  SELECT count(*) AS n FROM (SELECT DISTINCT client_id, purchase_date FROM sales)
), support AS (
  SELECT item, count(*) AS support FROM items GROUP BY 1
), pairs AS (
  SELECT a.item AS x, b.item AS y, count(*) AS frequency
  FROM items a JOIN items b
    ON a.client_id = b.client_id AND a.purchase_date = b.purchase_date AND a.item < b.item
  GROUP BY 1, 2
), metrics AS (
  SELECT x, y, frequency, sx.support AS support_x, sy.support AS support_y, n,
         frequency / sx.support * 100 AS confidence,
         CAST(sx.support AS DOUBLE) * sy.support / n AS expected,
         frequency / (CAST(sx.support AS DOUBLE) * sy.support / n) AS lift
  FROM pairs JOIN support sx ON sx.item = x JOIN support sy ON sy.item = y CROSS JOIN n
)"""
