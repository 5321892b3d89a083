"""Queries on prices and on the comparison of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.operators import compare, pricing
from bidlake.plans import adapters as a
from bidlake.plans.sql import AS_OF, BASE, PRICED, SCORED, with_
from bidlake.sources.sinks import shared_table


def _double(*names: str) -> list:
    return [F.col(n).cast("double").alias(n) for n in names]


def comparison(spark: SparkSession, sf_dir: str) -> compare.Comparison:
    """The whole comparison; the joined line items are written once, since quotes, lines and history all read them."""
    rows = shared_table(a.base(spark, sf_dir), "line_items")
    return compare.compare_quotes(
        a.quotes(spark, sf_dir, rows), a.quote_lines(spark, sf_dir, rows), a.rfqs(spark, sf_dir), a.requirements(spark, sf_dir), a.items(spark, sf_dir), a.suppliers(spark, sf_dir), a.history(spark, sf_dir, rows), a.settings(spark), a.AS_OF
    )


def quote_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pricing.quote_totals(a.quotes(spark, sf_dir), a.quote_lines(spark, sf_dir))
    return t.select("quote_id", "line_count", *_double("subtotal", "total"))


def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.base(spark, sf_dir)
    return b.select("purchase_id", pricing.line_total(F.col("quantity"), F.col("unit_price")).cast("double").alias("line_total"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = a.quote_rows(spark, sf_dir)
    return q.select("organization_id", F.col("quote_id").alias("probe_id"), "item_id", "currency", "uom", F.col("quote_date").alias("as_of"))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = pricing.price_history(_probes(spark, sf_dir), a.history(spark, sf_dir))
    return h.select(F.col("probe_id").alias("quote_id"), *_double("sum_183", "sum_92"), "n_183", "n_92", "last_date", *_double("last_price"))


def price_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = comparison(spark, sf_dir)
    return c.findings.where("code = 'PRICE_INCREASE'").select("rfq_id", "quote_id", "severity")


def rolling_price_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pricing.rolling_mean(a.history(spark, sf_dir))
    return r.select("purchase_id", *_double("sum_price"), "n_price")


def last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pricing.last_purchase(a.history(spark, sf_dir), F.lit(a.AS_OF).cast("date"))
    return p.select("item_id", "currency", "uom", "date", "purchase_id", "supplier_id", *_double("unit_price"))


def supplier_on_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.on_time(a.history(spark, sf_dir), "supplier_id")


def supplier_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pricing.supplier_spend(a.history(spark, sf_dir))
    return s.select("supplier_id", "currency", *_double("spend"), "orders", "lead_days", "leads", "on_time")


def response_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.quotes(spark, sf_dir).groupBy("rfq_id").agg(F.count_distinct("supplier_id").alias("responses"))


def quote_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).findings.select("rfq_id", "quote_id", "code", "severity")


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).findings.groupBy("code", "severity").agg(F.count("*").alias("n"))


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).quotes.select("rfq_id", "quote_id", "eligible", "comparable")


def scored_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = comparison(spark, sf_dir).quotes
    return q.select("rfq_id", "quote_id", *_double("total", "price_points", "lead_points", "reliability_points", "fit_points", "score"), "lowest_cost", "fastest", "rank")


def rfq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = comparison(spark, sf_dir).requests
    return r.select("rfq_id", "quotes", "eligible", "responses", "recommended_quote_id", "winner", *_double("winner_score", "winner_total", "savings"))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = compare.dashboard(a.rfqs(spark, sf_dir), a.quotes(spark, sf_dir), comparison(spark, sf_dir).requests)
    return d.select("open_rfqs", "awaiting", "quotes", "needs_review", "currency", *_double("savings"))


def duplicate_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison(spark, sf_dir).findings.where("code = 'DUPLICATE_QUOTE'").select("rfq_id", "quote_id")


def tier_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = a.quote_rows(spark, sf_dir)
    price = lambda f: (F.col("unit_price") * F.lit(f).cast("decimal(4,2)")).cast("decimal(18,6)")
    n = lambda x: F.lit(x).cast("decimal(18,4)")
    tier = lambda lo, hi, f: F.struct(n(lo).alias("minimum"), n(hi).alias("maximum"), price(f).alias("unit_price"))
    tiers = F.array(tier(1, 9, "1.10"), tier(10, 24, "1.05"), tier(25, None, "1.00")).cast(a.TIER)
    own = pricing.applicable_tiers(tiers, F.col("quantity"))
    return q.select("quote_id", F.size(own).alias("tiers"), own[0]["minimum"].cast("double").alias("minimum"), pricing.tier_mismatch(tiers, F.col("quantity"), F.col("unit_price")).alias("mismatch"))


def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of each quote's supplier without exactly one line: every supplier that quotes a part is asked for all parts of its brand."""
    parts = a.table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("rows"))
    return scope_gaps(a.quote_rows(spark, sf_dir).select("supplier_id", "item_id"), parts)


def scope_gaps(quoted: DataFrame, parts: DataFrame) -> DataFrame:
    """``brand, supplier_id, gaps, repeated``: of each supplier of ``quoted(supplier_id, item_id)`` and brand, the parts without exactly one line and those of
    several. ``parts(item_id, brand, rows)``. What a supplier was asked for is the number of a brand's parts less what it quotes once, so no part that it does
    not quote becomes a row."""
    lines = quoted.join(parts, "item_id").groupBy("brand", "supplier_id", "item_id", "rows").agg((F.count("*") * F.col("rows")).alias("n"))
    per = lines.groupBy("brand", "supplier_id").agg(F.count_if(F.col("n") == 1).alias("once"), F.sum(F.when(F.col("n") > 1, F.col("rows")).otherwise(0)).alias("repeated"))
    asked = parts.groupBy("brand").agg(F.sum("rows").alias("asked"))
    return per.join(asked, "brand").withColumn("gaps", F.col("asked") - F.col("once")).where("gaps > 0").select("brand", "supplier_id", "gaps", "repeated")


def finding_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that are new or gone between two states: before, odd requests had not expired; after, their price rises are settled."""
    f = comparison(spark, sf_dir).findings
    before = f.where("code <> 'QUOTE_EXPIRED' OR rfq_id % 2 = 0")
    after = f.where("code <> 'PRICE_INCREASE' OR rfq_id % 2 = 0")
    return compare.finding_delta(before, after).select("quote_id", "code", "change")


QUERIES = [line_totals, quote_totals, price_history, price_anomaly, rolling_price_mean, last_purchase, supplier_on_time, supplier_spend, response_counts, quote_findings, finding_counts, eligibility, scored_quotes, rfq_summary, dashboard, duplicate_quotes, tier_match, scope_check, finding_delta]

_CODES = (("f1", "CURRENCY_MISMATCH"), ("f2", "QUOTE_EXPIRED"), ("f3", "LOW_EXTRACTION_CONFIDENCE"), ("f3", "LOW_EXTRACTION_CONFIDENCE"), ("f4", "MISSING_COST"), ("f5", "DUPLICATE_QUOTE"), ("f6", "QUANTITY_MISMATCH"), ("f7", "MOQ_CONFLICT"), ("f8", "DELIVERY_RISK"), ("f9", "TOTAL_MISMATCH"), ("f10", "PRICE_INCREASE"))
_FINDINGS = PRICED + ",\nfound AS (" + " UNION ALL ".join(f"SELECT rfq_id, quote_id, '{code}' AS code, '{'warning' if flag == 'f10' else 'blocking'}' AS severity FROM x WHERE {flag}" for flag, code in _CODES) + ")"

SQL = {
    "finding_delta": with_(
        _FINDINGS,
        """SELECT quote_id, code, CASE code WHEN 'QUOTE_EXPIRED' THEN 'CREATED' ELSE 'RESOLVED' END AS change FROM found
WHERE code IN ('QUOTE_EXPIRED', 'PRICE_INCREASE') AND rfq_id % 2 = 1""",
    ),
    "line_totals": with_(BASE, "SELECT purchase_id, CAST(CAST(round(quantity * unit_price, 2) AS DECIMAL(18,2)) AS DOUBLE) AS line_total FROM v_base"),
    "quote_totals": with_(PRICED, "SELECT quote_id, 1 AS line_count, CAST(line_total AS DOUBLE) AS subtotal, CAST(total AS DOUBLE) AS total FROM t"),
    "price_history": with_(
        BASE,
        """SELECT quote_id, CAST(coalesce(sum(p.unit_price) FILTER (WHERE p.date >= quote_date - 183), 0) AS DOUBLE) AS sum_183,
       CAST(coalesce(sum(p.unit_price) FILTER (WHERE p.date >= quote_date - 92), 0) AS DOUBLE) AS sum_92,
       count(*) FILTER (WHERE p.date >= quote_date - 183) AS n_183, count(*) FILTER (WHERE p.date >= quote_date - 92) AS n_92,
       max(p.date) AS last_date, CAST(arg_max(p.unit_price, (p.date, p.purchase_id)) AS DOUBLE) AS last_price
FROM v_quote q LEFT JOIN v_history p ON p.item_id = q.item_id AND p.currency = q.currency AND p.uom = q.uom AND p.date <= q.quote_date
GROUP BY quote_id""",
    ),
    "price_anomaly": with_(PRICED, "SELECT rfq_id, quote_id, 'warning' AS severity FROM x WHERE f10"),
    "rolling_price_mean": with_(
        BASE,
        """SELECT purchase_id, CAST(sum(unit_price) OVER w AS DOUBLE) AS sum_price, count(unit_price) OVER w AS n_price FROM v_history
WINDOW w AS (PARTITION BY item_id, currency, uom ORDER BY date RANGE BETWEEN INTERVAL 183 DAYS PRECEDING AND CURRENT ROW)""",
    ),
    "last_purchase": with_(
        BASE,
        f"""SELECT item_id, currency, uom, date, purchase_id, supplier_id, CAST(unit_price AS DOUBLE) AS unit_price FROM v_history WHERE date <= {AS_OF}
QUALIFY row_number() OVER (PARTITION BY item_id, currency, uom ORDER BY date DESC, purchase_id DESC) = 1""",
    ),
    "supplier_on_time": with_(BASE, "SELECT supplier_id, count(*) AS orders, count(*) FILTER (WHERE actual_delivery <= expected_delivery) AS on_time FROM v_history WHERE actual_delivery IS NOT NULL GROUP BY supplier_id"),
    "supplier_spend": with_(
        BASE,
        """SELECT supplier_id, currency, CAST(sum(CAST(round(quantity * unit_price, 2) AS DECIMAL(18,2))) AS DOUBLE) AS spend, count(*) AS orders, CAST(sum(lead_time_days) AS BIGINT) AS lead_days,
       count(lead_time_days) AS leads, count(*) FILTER (WHERE actual_delivery <= expected_delivery) AS on_time FROM v_history GROUP BY supplier_id, currency""",
    ),
    "response_counts": with_(BASE, "SELECT rfq_id, count(DISTINCT supplier_id) AS responses FROM v_quote GROUP BY rfq_id"),
    "quote_findings": with_(_FINDINGS, "SELECT * FROM found"),
    "finding_counts": with_(_FINDINGS, "SELECT code, severity, count(*) AS n FROM found GROUP BY ALL"),
    "eligibility": with_(SCORED, "SELECT rfq_id, quote_id, eligible, comparable FROM e"),
    "scored_quotes": with_(
        SCORED,
        """SELECT rfq_id, quote_id, CAST(total AS DOUBLE) AS total, price_cents / 100 AS price_points, lead_cents / 100 AS lead_points, reliability_cents / 100 AS reliability_points, fit_cents / 100 AS fit_points,
       score_cents / 100 AS score, comparable AND coalesce(total = lowest, false) AS lowest_cost, comparable AND lead_time_days = soonest AS fastest, rank FROM ranked""",
    ),
    "rfq_summary": with_(
        SCORED,
        """SELECT p_partkey AS rfq_id, count(quote_id) AS quotes, count(*) FILTER (WHERE eligible) AS eligible, count(DISTINCT supplier_id) AS responses,
       max(CASE WHEN rank = 1 THEN quote_id END) AS recommended_quote_id, max(CASE WHEN rank = 1 THEN supplier_name END) AS winner, max(CASE WHEN rank = 1 THEN score_cents END) / 100 AS winner_score,
       CAST(max(CASE WHEN rank = 1 THEN total END) AS DOUBLE) AS winner_total, CAST(coalesce(greatest(max(CASE WHEN rank = 1 THEN highest - total END), 0), 0) AS DOUBLE) AS savings
FROM part LEFT JOIN ranked ON p_partkey = rfq_id GROUP BY p_partkey""",
    ),
    "dashboard": with_(
        SCORED,
        """SELECT (SELECT count(*) FROM part) AS open_rfqs,
       (SELECT CAST(sum(greatest(5 - coalesce(n, 0), 0)) AS BIGINT) FROM part LEFT JOIN (SELECT rfq_id, count(DISTINCT supplier_id) AS n FROM v_quote GROUP BY 1) ON p_partkey = rfq_id) AS awaiting,
       (SELECT count(*) FROM v_quote) AS quotes, (SELECT count(*) FROM v_quote) AS needs_review, 'USD' AS currency,
       (SELECT CAST(sum(greatest(highest - total, 0)) AS DOUBLE) FROM ranked WHERE rank = 1) AS savings""",
    ),
    "duplicate_quotes": with_(PRICED, "SELECT rfq_id, quote_id FROM x WHERE f5"),
    "tier_match": with_(BASE, "SELECT quote_id, 1 AS tiers, CASE WHEN quantity < 10 THEN 1.0 WHEN quantity < 25 THEN 10.0 ELSE 25.0 END::DOUBLE AS minimum, quantity < 25 AS mismatch FROM v_quote"),
    "scope_check": with_(
        BASE
        + """,
q AS (SELECT p_brand AS brand, supplier_id, item_id FROM v_quote JOIN part ON item_id = p_partkey),
n AS (SELECT brand, supplier_id, item_id, count(*) AS n FROM q GROUP BY ALL),
asked AS (SELECT brand, supplier_id, p_partkey AS item_id FROM (SELECT DISTINCT brand, supplier_id FROM q) JOIN part ON brand = p_brand)""",
        "SELECT brand, supplier_id, count(*) AS gaps, count(n) AS repeated FROM asked LEFT JOIN n USING (brand, supplier_id, item_id) WHERE n IS DISTINCT FROM 1 GROUP BY ALL",
    ),
}
