"""Shared parts of the reference SQL: the driver tables read as procurement tables."""

AS_OF = "DATE '2002-06-01'"

BASE = """
v_base AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS purchase_id, l_orderkey AS po_number, l_linenumber AS line_no,
         CAST(o_orderdate AS DATE) AS date, l_suppkey AS supplier_id, s_name AS supplier_name, l_partkey AS item_id,
         CAST(l_quantity AS DECIMAL(18,4)) AS quantity, CAST(((CAST(round(l_extendedprice * 100) AS BIGINT) * 20000 + CAST(l_quantity AS BIGINT)) // (CAST(l_quantity AS BIGINT) * 2)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6)) AS unit_price,
         CASE WHEN s_nationkey % 3 = 1 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN p_size % 2 = 0 THEN 'EA' ELSE 'BOX' END AS uom,
         CAST(o_orderdate AS DATE) + 30 AS expected_delivery,
         CASE WHEN CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) THEN CAST(l_shipdate AS DATE) END AS actual_delivery,
         l_linenumber * 7 AS lead_time_days, l_linestatus, l_returnflag, l_discount, l_tax, l_extendedprice, o_orderpriority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
v_history AS (SELECT * FROM v_base WHERE l_linestatus = 'F'),
v_quote AS (
  SELECT purchase_id AS quote_id, item_id AS rfq_id, item_id, supplier_id, supplier_name, line_no, unit_price, currency, uom, lead_time_days,
         CAST(po_number % 3 AS VARCHAR) AS quote_number, date AS quote_date, date + 730 AS expiration_date,
         CASE WHEN line_no = 7 THEN quantity ELSE CAST(25 AS DECIMAL(18,4)) END AS quantity, CAST(line_no * 5 AS DECIMAL(18,4)) AS moq,
         CASE WHEN NOT (l_returnflag = 'N' AND line_no = 1) THEN CAST(l_tax * 1000 AS DECIMAL(18,4)) END AS shipping_cost,
         CAST(0 AS DECIMAL(18,4)) AS tax, CASE WHEN l_discount >= 0.09 THEN 0.7 ELSE 0.95 END AS confidence,
         CASE WHEN l_returnflag = 'R' AND line_no = 5 THEN CAST(l_extendedprice AS DECIMAL(18,4)) END AS stated_line_total
  FROM v_base WHERE l_linestatus = 'O' AND date >= DATE '2000-01-01')"""

#: Totals of one-line quotes, sums over the six months before, and the findings' conditions.
PRICED = (
    BASE
    + f""",
t AS (
  SELECT *, CAST(round(quantity * unit_price, 2) AS DECIMAL(18,2)) AS line_total,
         CAST(round(CAST(round(quantity * unit_price, 2) AS DECIMAL(18,2)) + shipping_cost + tax, 2) AS DECIMAL(18,2)) AS total
  FROM v_quote),
h AS (
  SELECT quote_id, coalesce(sum(p.unit_price), 0) AS s, count(p.unit_price) AS n
  FROM v_quote q LEFT JOIN v_history p ON p.item_id = q.item_id AND p.currency = q.currency AND p.uom = q.uom
       AND p.date <= {AS_OF} AND p.date <= q.quote_date AND p.date >= q.quote_date - 183
  GROUP BY quote_id),
same AS (SELECT rfq_id, supplier_id, quote_number, count(*) AS same_number FROM v_quote GROUP BY ALL),
x AS (
  SELECT t.*, h.s, h.n, same_number,
         currency <> 'USD' AS f1, expiration_date < {AS_OF} AS f2, confidence < 0.8 AS f3, shipping_cost IS NULL AS f4, same_number > 1 AS f5,
         quantity <> 25 AS f6, moq > 25 AS f7, {AS_OF} + lead_time_days > {AS_OF} + 30 AS f8,
         coalesce(CAST(round(stated_line_total, 2) AS DECIMAL(18,2)) <> line_total, false) AS f9,
         s <> 0 AND (CAST(unit_price AS DECIMAL(18,6)) * n - s) * 10 >= s AS f10
  FROM t JOIN h USING (quote_id) JOIN same USING (rfq_id, supplier_id, quote_number))"""
)

#: The whole comparison: factors, score, rank.
SCORED = (
    PRICED
    + f""",
rel AS (
  SELECT q.rfq_id, q.supplier_id, count(*) AS orders, count(*) FILTER (WHERE p.actual_delivery <= p.expected_delivery) AS on_time
  FROM (SELECT DISTINCT rfq_id, supplier_id FROM v_quote) q JOIN v_history p ON p.item_id = q.rfq_id AND p.supplier_id = q.supplier_id
  WHERE p.actual_delivery IS NOT NULL AND p.date <= {AS_OF} GROUP BY ALL),
e AS (
  SELECT x.*, coalesce(orders, 0) AS orders, coalesce(on_time, 0) AS on_time, total IS NOT NULL AND NOT (f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7 OR f8 OR f9) AS eligible,
         NOT f1 AND NOT f6 AND total IS NOT NULL AS comparable
  FROM x LEFT JOIN rel USING (rfq_id, supplier_id)),
m AS (
  SELECT *, min(CASE WHEN comparable THEN total END) OVER (PARTITION BY rfq_id) AS lowest, max(CASE WHEN comparable THEN total END) OVER (PARTITION BY rfq_id) AS highest,
         coalesce(min(CASE WHEN comparable THEN lead_time_days END) OVER (PARTITION BY rfq_id), 0) AS soonest
  FROM e),
half AS (
  SELECT *,
         CASE WHEN NOT comparable THEN 0 WHEN total <= 0 THEN 5000 ELSE (CAST(lowest * 100 AS BIGINT) * 10000 + CAST(total * 100 AS BIGINT)) // (CAST(total * 100 AS BIGINT) * 2) END AS price_cents,
         CASE WHEN soonest >= lead_time_days THEN 2500 ELSE ((soonest + 1) * 5000 + (lead_time_days + 1)) // ((lead_time_days + 1) * 2) END AS lead_cents,
         CASE WHEN orders = 0 THEN 750 ELSE (on_time * 3000 + orders) // (orders * 2) END AS reliability_cents,
         CASE WHEN eligible THEN 1000 ELSE 0 END AS fit_cents
  FROM m),
scored AS (
  SELECT *, CASE WHEN NOT f1 THEN price_cents + lead_cents + reliability_cents + fit_cents END AS score_cents FROM half),
ranked AS (
  SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY rfq_id, eligible ORDER BY score_cents DESC, total, supplier_name, quote_date, quote_id) END AS rank FROM scored)"""
)


def with_(parts: str, select: str) -> str:
    return f"WITH {parts.strip()}\n{select}"
