"""Queries of a buyer's desk: recommendations, profiles, proposals, corrections, retries, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.operators import browse, changes, compare, mail, matching, pricing
from bidlake.plans import adapters as a
from bidlake.plans.pricing import comparison
from bidlake.plans.sql import BASE, SCORED, with_
from bidlake.sources import files, sinks

ORG = "organization_id"


def recommendation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations made for each request's winner, or for its greatest quote id where the request is even."""
    c = comparison(spark, sf_dir)
    greatest = c.quotes.groupBy(ORG, "rfq_id").agg(F.max("quote_id").alias("any_quote"))
    r = c.requests.select(ORG, "rfq_id", "recommended_quote_id").join(greatest, [ORG, "rfq_id"])
    r = r.select(ORG, "rfq_id", F.when(F.col("rfq_id") % 2 == 0, F.col("any_quote")).otherwise(F.col("recommended_quote_id")).alias("quote_id"), F.when(F.col("rfq_id") % 5 == 0, 0).otherwise(1).alias("revision"), F.when(F.col("rfq_id") % 7 == 0, "Stale").otherwise("Current").alias("status"))
    return compare.recommendation_gate(r, a.rfqs(spark, sf_dir), c.requests, a.quotes(spark, sf_dir)).select("rfq_id", "reason")


def supplier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = a.history(spark, sf_dir)
    p = browse.supplier_profile(a.suppliers(spark, sf_dir), pricing.supplier_spend(h), h, 3)
    return p.select("supplier_id", "orders", "on_time", F.size("spend").alias("currencies"), F.array_join(F.transform("recent", lambda x: x["purchase_id"]), ",").alias("recent"))


def prior_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.base(spark, sf_dir)
    m = b.select(ORG, F.concat_ws("-", "supplier_id", "item_id").alias("thread_id"), F.col("purchase_id").alias("email_id"), F.col("date").alias("sent_at"), F.when(F.col("line_no") != 4, F.concat(F.lit("q"), "purchase_id")).alias("quote_id"))
    return changes.prior_quote(m).select("email_id", "prior_quote_id")


def mapping_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.base(spark, sf_dir)
    row = b.select(ORG, "supplier_id", F.concat(F.lit("x"), F.col("item_id") % 40).alias("supplier_sku"), "item_id", F.col("date").cast("timestamp").alias("reviewed_at"), "l_linestatus")
    current = row.where("l_linestatus = 'F'").groupBy(ORG, "supplier_id", "supplier_sku").agg(F.min("item_id").alias("item_id"))
    return matching.confirmed_mappings(current, row.where("l_linestatus = 'O'")).select("supplier_id", "supplier_sku", "item_id")


def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = a.quotes(spark, sf_dir).withColumn("document_id", F.concat(F.lit("d"), "quote_id"))
    new = q.withColumn("currency", F.when(F.col("rfq_id") % 9 == 0, "CHF").otherwise(F.col("currency"))).withColumn("quote_number", F.when(F.col("rfq_id") % 8 == 0, None).otherwise(F.col("quote_number")))
    one = q.select(ORG, "document_id", F.concat(F.lit("x1"), "document_id").alias("extraction_id"), F.lit("m1").alias("model"), F.lit("p1").alias("prompt_version"), F.lit("v1").alias("pipeline_version"), F.lit('{"currency":"usd"}').alias("raw"), F.col("created_at"))
    two = one.where("length(document_id) % 2 = 0").withColumns({"extraction_id": F.concat(F.lit("x2"), "document_id"), "model": F.lit("m2"), "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY")})
    return changes.correction_log(q, new, one.unionByName(two), ["currency", "quote_number"]).select("quote_id", "field", "old_value", "new_value", "model", "model_value")


def retry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "PROCESSING").when(F.col("event_type") == "click", "NEEDS_REVIEW").otherwise("COMPLETE").alias("status"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).alias("quote_id"))
    return browse.retryable(rows).select("event_id", "status", "refused")


def fallback_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.base(spark, sf_dir)
    m = b.select(ORG, F.col("purchase_id").alias("message_id"), F.concat(F.lit("Offer "), F.col("item_id") % 20).alias("normalized_subject"), "supplier_id", (F.col("item_id") % 20).alias("rfq_id"), F.col("date").cast("timestamp").alias("sent_at"))
    t = mail.join_threads(m)
    return t.groupBy("supplier_id", "rfq_id", "session").agg(F.count("*").alias("n"), F.min("message_id").alias("first_id"))


def supplier_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = a.table(spark, sf_dir, "customer"), F.col("c_custkey")
    method = F.element_at(F.array(*map(F.lit, ("NO_MATCH", "EXACT_CONTACT_EMAIL", "EXACT_VERIFIED_DOMAIN", "AMBIGUOUS_EXACT_VERIFIED_DOMAIN"))), (k % 4 + 1).cast("int"))
    m = c.select(F.lit(a.TENANT).alias(ORG), k.alias("left_id"), method.alias("method"), F.when(k % 3 == 0, "x@gmail.com").otherwise("x@own.example").alias("email"), F.concat(F.lit("Firm "), k % 30, F.lit(" Ltd")).alias("name"))
    return matching.propose_suppliers(m).select("left_id", "action", "proposed")


def line_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = a.quote_rows(spark, sf_dir).withColumns({"currency": F.when(F.col("rfq_id") % 6 == 0, "usd").otherwise(F.col("currency")), "lead_time_days": F.col("lead_time_days") - 7, "quantity": F.when(F.col("rfq_id") % 10 == 0, 0).otherwise(F.col("quantity"))})
    return q.select("quote_id", F.explode(files.violations(files.quote_line_rules())).alias("code"))


def redacted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = browse.redacted(a.quotes(spark, sf_dir).withColumn("raw_text", F.lit("secret")).select("quote_id", "raw_text", "shipping_cost", "currency"))
    return browse.filtered(q, currency="EUR", nothing=1)


def audit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = a.rfqs(spark, sf_dir).select(ORG, "rfq_id", "status", F.when(F.col("rfq_id") % 2 == 0, "Closed").otherwise(F.col("status")).alias("new_status")).where("status <> new_status")
    return sinks.audit_rows(r, "RFQ_CHANGED", "rfq", "rfq_id", F.struct("status"), F.struct(F.col("new_status").alias("status"))).select("entity_id", "old_values", "new_values")


QUERIES = [recommendation_gate, supplier_profile, prior_quotes, mapping_upsert, correction_log, retry_selection, fallback_threads, supplier_proposals, line_violations, redacted_quotes, audit_changes]

SQL = {
    "recommendation_gate": with_(
        SCORED + ", w AS (SELECT rfq_id, max(quote_id) AS any_quote, max(CASE WHEN rank = 1 THEN quote_id END) AS winner FROM ranked GROUP BY rfq_id)",
        """SELECT rfq_id, CASE WHEN rfq_id % 7 = 0 THEN 'STALE' WHEN rfq_id % 5 = 0 THEN 'REQUEST_CHANGED' WHEN rfq_id % 2 = 0 AND any_quote IS DISTINCT FROM winner THEN 'WINNER_CHANGED' ELSE 'QUOTE_NOT_REVIEWED' END AS reason FROM w""",
    ),
    "supplier_profile": with_(
        BASE
        + """,
n AS (SELECT supplier_id, purchase_id, date, row_number() OVER (PARTITION BY supplier_id ORDER BY date DESC, purchase_id DESC) AS i FROM v_history),
r AS (SELECT supplier_id, string_agg(purchase_id, ',' ORDER BY i) AS recent FROM n WHERE i <= 3 GROUP BY supplier_id),
s AS (SELECT supplier_id, count(*) AS orders, count(*) FILTER (WHERE actual_delivery <= expected_delivery) AS on_time, count(DISTINCT currency)::INT AS currencies FROM v_history GROUP BY supplier_id)""",
        "SELECT s_suppkey AS supplier_id, orders, on_time, currencies, recent FROM supplier LEFT JOIN s ON s_suppkey = s.supplier_id LEFT JOIN r ON s_suppkey = r.supplier_id",
    ),
    "prior_quotes": with_(BASE, "SELECT purchase_id AS email_id, last_value(CASE WHEN line_no <> 4 THEN 'q' || purchase_id END IGNORE NULLS) OVER (PARTITION BY supplier_id, item_id ORDER BY date, purchase_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_quote_id FROM v_base"),
    "mapping_upsert": with_(
        BASE
        + """,
o AS (SELECT supplier_id, 'x' || item_id % 40 AS supplier_sku, arg_max(item_id, (date, item_id)) AS item_id FROM v_base WHERE l_linestatus = 'O' GROUP BY ALL),
f AS (SELECT supplier_id, 'x' || item_id % 40 AS supplier_sku, min(item_id) AS item_id FROM v_base WHERE l_linestatus = 'F' GROUP BY ALL)""",
        "SELECT supplier_id, supplier_sku, coalesce(o.item_id, f.item_id) AS item_id FROM o FULL JOIN f USING (supplier_id, supplier_sku)",
    ),
    "correction_log": with_(
        BASE + ", m AS (SELECT *, CASE WHEN length('d' || quote_id) % 2 = 0 THEN 'm2' ELSE 'm1' END AS model FROM v_quote)",
        """SELECT quote_id, 'currency' AS field, currency AS old_value, 'CHF' AS new_value, model, 'usd' AS model_value FROM m WHERE rfq_id % 9 = 0
UNION ALL SELECT quote_id, 'quote_number', quote_number, NULL, model, NULL FROM m WHERE rfq_id % 8 = 0""",
    ),
    "retry_selection": """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'NEEDS_REVIEW' ELSE 'COMPLETE' END AS s, event_id % 4 = 0 AS q FROM events)
SELECT event_id, CASE WHEN s IN ('FAILED', 'NEEDS_REVIEW') AND NOT q THEN 'RECEIVED' ELSE s END AS status, CASE WHEN s IN ('FAILED', 'NEEDS_REVIEW') AND NOT q THEN NULL WHEN q THEN 'HAS_QUOTE' WHEN s = 'PROCESSING' THEN 'PROCESSING' ELSE 'NOT_FAILED' END AS refused FROM e""",
    "fallback_threads": with_(
        BASE
        + """,
n AS (SELECT supplier_id, item_id % 20 AS rfq_id, purchase_id, date, CASE WHEN coalesce(date > lag(date) OVER w + 30, true) THEN 1 ELSE 0 END AS new FROM v_base WINDOW w AS (PARTITION BY supplier_id, item_id % 20 ORDER BY date, purchase_id)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY supplier_id, rfq_id ORDER BY date, purchase_id) AS BIGINT) AS session FROM n)""",
        "SELECT supplier_id, rfq_id, session, count(*) AS n, min(purchase_id) AS first_id FROM s GROUP BY ALL",
    ),
    "supplier_proposals": """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'REVIEW' ELSE 'NEW_UNVERIFIED' END WHEN c_custkey % 4 = 1 THEN 'NONE' WHEN c_custkey % 4 = 2 THEN 'ADD_CONTACT' ELSE 'REVIEW' END AS action FROM customer)
SELECT k AS left_id, action, action = 'NEW_UNVERIFIED' AND row_number() OVER (PARTITION BY action, k % 30 ORDER BY k) = 1 AS proposed FROM c""",
    "line_violations": with_(BASE, "SELECT quote_id, 'CURRENCY_CODE' AS code FROM v_quote WHERE rfq_id % 6 = 0 UNION ALL SELECT quote_id, 'QUANTITY_RANGE' FROM v_quote WHERE rfq_id % 10 = 0"),
    "redacted_quotes": with_(BASE, "SELECT quote_id, CAST(shipping_cost AS VARCHAR) AS shipping_cost, currency FROM v_quote WHERE currency = 'EUR'"),
    "audit_changes": """SELECT CAST(p_partkey AS VARCHAR) AS entity_id, '{"status":"Open"}' AS old_values, '{"status":"Closed"}' AS new_values FROM part WHERE p_partkey % 2 = 0""",
}
