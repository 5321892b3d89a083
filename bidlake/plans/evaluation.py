"""Queries on the quality of extractions: lines of orders as wanted and given values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.operators import evaluate, facts
from bidlake.plans import adapters as a
from bidlake.plans.sql import BASE, with_

FIELDS = ("supplier_sku", "quantity", "uom", "unit_price", "moq", "lead_time_days")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of each line, as text: the given one has planted errors by its keys."""
    b = a.base(spark, sf_dir)
    k = F.pmod(F.col("item_id") + F.col("supplier_id"), F.lit(20))
    n = F.row_number().over(Window.partitionBy("po_number").orderBy("line_no", "purchase_id")) - 1
    text = lambda c: c.cast("string")
    qty = F.col("quantity").cast("int")
    return b.select(
        F.col("po_number").alias("doc_id"), n.cast("int").alias("line_no"), k.alias("k"),
        text(F.col("item_id")).alias("w_supplier_sku"), text(qty).alias("w_quantity"), F.col("uom").alias("w_uom"), text(F.col("unit_price")).alias("w_unit_price"), F.when(k != 1, "5").alias("w_moq"), F.when(k != 2, text(F.col("lead_time_days"))).alias("w_lead_time_days"),
        text(F.col("item_id")).alias("g_supplier_sku"), F.when(k == 3, "0").when(k != 4, F.concat(text(qty), F.lit(".0"))).alias("g_quantity"), F.when(F.col("uom") == "EA", "Pieces").otherwise("boxes").alias("g_uom"),
        text(F.when(k == 5, F.col("unit_price") * 10).when(k == 6, F.col("unit_price") + 1).otherwise(F.col("unit_price")).cast("decimal(20,6)")).alias("g_unit_price"), F.lit("5").alias("g_moq"), F.when(k != 7, text(F.col("lead_time_days"))).alias("g_lead_time_days"),
    )


def _long(df: DataFrame, side: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{side}_{f}").alias("value")) for f in FIELDS))
    return df.select("doc_id", "line_no", F.explode(pairs).alias("p")).select("doc_id", "line_no", "p.*")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wide(spark, sf_dir)
    failed = a.table(spark, sf_dir, "orders").where("o_orderkey % 17 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return evaluate.scored(evaluate.observations(_long(w, "w"), _long(w, "g"), failed))


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.field_scores(_scores(spark, sf_dir))


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_taxonomy(_scores(spark, sf_dir))


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.document_scores(_scores(spark, sf_dir))


def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.first_errors(_scores(spark, sf_dir))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of an order against the same lines in reverse, without every 9th one."""
    w = _wide(spark, sf_dir).withColumn("sku", F.col("w_supplier_sku"))
    back = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("line_no").desc())) - 1
    return w.select("doc_id", "line_no", "sku"), w.where("k <> 9").select("doc_id", back.cast("int").alias("line_no"), "sku")


def line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.align_lines(*_sides(spark, sf_dir)).select("doc_id", "wanted_no", "given_no", "by_sku")


def line_alignment_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.align_lines_sql(*_sides(spark, sf_dir)).select("doc_id", "wanted_no", "given_no", "by_sku")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("doc_id"), F.col("event_type").alias("origin"), F.concat(F.lit("f"), F.col("user_id") % 4).alias("format"), (k % 13 != 0).alias("success"), F.when(k % 5 != 0, k % 3 == 0).alias("needs_review"), (k % 7).cast("long").alias("critical_correct"), F.lit(6).cast("long").alias("critical_total"),
        (k % 3).cast("long").alias("associated"), F.lit(2).cast("long").alias("lines"), F.when(k % 11 != 0, F.col("value")).alias("seconds"), (k % 10 == 0).alias("attack"), F.when(k % 4 == 0, F.array(F.lit("tiers"), F.lit("missing"))).otherwise(F.array(F.lit("plain"))).alias("scenarios"),
        F.col("value").alias("parsing_seconds"), (F.floor("value") / 4).alias("model_seconds"),
    )


def by_format_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.run_summary(_runs(spark, sf_dir), "origin", "format")


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency(_runs(spark, sf_dir), ["seconds", "parsing_seconds", "model_seconds"])


def scenario_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scenario_success(_runs(spark, sf_dir), ["tiers", "discount"])


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _wide(spark, sf_dir)
    d = _long(w, "g").withColumnRenamed("value", "model_value")
    k = F.pmod(F.col("doc_id") + F.col("line_no"), F.lit(6))
    return d.withColumn("decision", F.when((k == 0) & (F.col("field") != "moq"), "REVIEW_REQUIRED").when(k == 1, "REJECTED").otherwise("ACCEPTED"))


def review_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.review_burden(_decisions(spark, sf_dir))


def safety_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    runs = o.select(k.alias("doc_id"), (k % 17 != 0).alias("success"), F.when(k % 3 != 0, k % 3 == 1).alias("needs_review"), (k % 8 == 0).alias("attack"))
    return evaluate.safety(_scores(spark, sf_dir), runs, _decisions(spark, sf_dir))


QUERIES = [field_scores, error_taxonomy, document_scores, first_errors, line_alignment, line_alignment_sql, by_format_report, latency_stats, scenario_success, review_burden, safety_ratios]

_WIDE = (
    BASE
    + """,
w AS (
  SELECT po_number AS doc_id, (row_number() OVER (PARTITION BY po_number ORDER BY line_no, purchase_id) - 1)::INT AS line_no, (item_id + supplier_id) % 20 AS k, po_number % 17 = 0 AS failed, item_id::VARCHAR AS sku FROM v_base),
o AS (
  SELECT doc_id, line_no, k, failed, 'supplier_sku' AS field, true AS has_w, true AS has_g, true AS ok, true AS same, 'SKU_EXTRACTION_ERROR' AS code FROM w
  UNION ALL SELECT doc_id, line_no, k, failed, 'quantity', true, k <> 4, k NOT IN (3, 4), false, 'QUANTITY_EXTRACTION_ERROR' FROM w UNION ALL SELECT doc_id, line_no, k, failed, 'uom', true, true, true, false, 'UOM_ERROR' FROM w
  UNION ALL SELECT doc_id, line_no, k, failed, 'unit_price', true, true, k NOT IN (5, 6), k NOT IN (5, 6), CASE WHEN k = 5 THEN 'DECIMAL_ERROR' ELSE 'UNIT_PRICE_ERROR' END FROM w
  UNION ALL SELECT doc_id, line_no, k, failed, 'moq', k <> 1, true, k <> 1, k <> 1, 'MOQ_ERROR' FROM w UNION ALL SELECT doc_id, line_no, k, failed, 'lead_time_days', k <> 2, k <> 7, k NOT IN (2, 7), k NOT IN (2, 7), 'LEAD_TIME_ERROR' FROM w),
s AS (
  SELECT doc_id, line_no, k, field, failed, has_w, has_g, ok, ok AND NOT failed AS correct, same AND NOT failed AS exact, field IN ('supplier_sku', 'quantity', 'uom', 'unit_price') AS critical,
         CASE WHEN ok AND NOT failed THEN NULL WHEN code = 'DECIMAL_ERROR' THEN code WHEN failed THEN 'SCHEMA_ERROR' WHEN NOT has_w THEN 'HALLUCINATED_FIELD' WHEN NOT has_g THEN 'MISSING_FIELD' ELSE code END AS error FROM o)"""
)


def _pct(n: str, d: str) -> str:
    return f"CASE WHEN {d} <> 0 THEN ((({n}) * 200000 + ({d})) // (({d}) * 2))::DOUBLE / 1000 END"


_N = {"total": "count(*)", "correct": "count(*) FILTER (WHERE correct)", "exact": "count(*) FILTER (WHERE exact)", "present_total": "count(*) FILTER (WHERE has_w)", "present_correct": "count(*) FILTER (WHERE has_w AND correct)", "null_total": "count(*) FILTER (WHERE NOT has_w)", "null_correct": "count(*) FILTER (WHERE NOT has_w AND correct)"}
_RUNS = """r AS (SELECT event_id AS k, event_type AS origin, 'f' || user_id % 4 AS format, event_id % 13 <> 0 AS success, coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id % 3 = 0 END, true) OR event_id % 13 = 0 AS review,
  event_id % 7 AS cc, event_id % 3 AS assoc, CASE WHEN event_id % 11 <> 0 THEN value ELSE 0 END AS seconds, value FROM events)"""
_SUMMARY = ", ".join(
    [
        "count(*) AS documents", f"{_pct('count(*) FILTER (WHERE success)', 'count(*)')} AS schema_validity", f"{_pct('count(*) FILTER (WHERE success AND cc = 6)', 'count(*)')} AS document_success", f"{_pct('sum(cc)::BIGINT', 'count(*) * 6')} AS critical_accuracy",
        f"{_pct('sum(assoc)::BIGINT', 'count(*) * 2')} AS association_accuracy", f"{_pct('count(*) FILTER (WHERE review)', 'count(*)')} AS review_rate", "median(seconds) AS median_seconds", "quantile_disc(seconds, 0.95) AS p95_seconds",
    ]
)

SQL = {
    "field_scores": with_(
        _WIDE,
        "SELECT field, " + ", ".join(f"{v} AS {k}" for k, v in _N.items()) + ", " + ", ".join(f"{_pct(_N[n], _N[d])} AS {k}" for k, n, d in (("accuracy", "correct", "total"), ("exact_accuracy", "exact", "total"), ("present_accuracy", "present_correct", "present_total"), ("null_accuracy", "null_correct", "null_total"))) + " FROM s GROUP BY field",
    ),
    "error_taxonomy": with_(_WIDE, "SELECT error, count(*) AS n FROM s WHERE error IS NOT NULL GROUP BY error"),
    "document_scores": with_(_WIDE, "SELECT doc_id, count(*) FILTER (WHERE critical AND correct) AS critical_correct, count(*) FILTER (WHERE critical) AS critical_total, count(error) AS errors FROM s GROUP BY doc_id"),
    "first_errors": with_(_WIDE, "SELECT doc_id, line_no, field, error FROM s WHERE error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no, field) = 1 ORDER BY doc_id LIMIT 30"),
    "line_alignment_sql": with_(
        _WIDE
        + """,
g AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) - 1)::INT AS line_no, sku FROM w WHERE k <> 9),
wn AS (SELECT doc_id, sku, line_no AS wanted_no, row_number() OVER (PARTITION BY doc_id, sku ORDER BY line_no) AS n FROM w), gn AS (SELECT doc_id, sku, line_no AS given_no, row_number() OVER (PARTITION BY doc_id, sku ORDER BY line_no) AS n FROM g),
hit AS (SELECT doc_id, wanted_no, given_no FROM wn JOIN gn USING (doc_id, sku, n)),
lw AS (SELECT doc_id, wanted_no, row_number() OVER (PARTITION BY doc_id ORDER BY wanted_no) AS i FROM wn ANTI JOIN hit USING (doc_id, wanted_no)), lg AS (SELECT doc_id, given_no, row_number() OVER (PARTITION BY doc_id ORDER BY given_no) AS i FROM gn ANTI JOIN hit USING (doc_id, given_no))""",
        "SELECT doc_id, wanted_no, given_no, true AS by_sku FROM hit UNION ALL SELECT doc_id, wanted_no, given_no, false FROM lw FULL JOIN lg USING (doc_id, i)",
    ),
    "by_format_report": with_(_RUNS, f"SELECT origin, format, {_SUMMARY} FROM r GROUP BY GROUPING SETS ((origin), (format), ())"),
    "latency_stats": with_(
        _RUNS + ", x AS (SELECT 'seconds' AS stage, seconds AS v FROM r UNION ALL SELECT 'parsing_seconds', value FROM r UNION ALL SELECT 'model_seconds', floor(value) / 4 FROM r)",
        "SELECT stage, count(*) AS n, median(v) AS median, quantile_disc(v, 0.95) AS p95 FROM x GROUP BY stage",
    ),
    "scenario_success": with_(_RUNS, f"SELECT count(*) FILTER (WHERE success AND assoc = 2) AS correct, count(*) AS documents, {_pct('count(*) FILTER (WHERE success AND assoc = 2)', 'count(*)')} AS percent FROM r WHERE k % 4 = 0"),
    "review_burden": with_(
        _WIDE + ", d AS (SELECT doc_id, count(*) FILTER (WHERE (doc_id + line_no) % 6 = 0 AND field <> 'moq') AS f, count(*) FILTER (WHERE (doc_id + line_no) % 6 = 0 AND critical) AS c FROM s GROUP BY doc_id)",
        "SELECT count(*) AS documents, median(f) AS fields, median(c) AS critical_fields FROM d",
    ),
    "safety_ratios": with_(
        _WIDE
        + """,
per AS (SELECT doc_id, count(*) FILTER (WHERE has_g AND NOT ok) AS wrong, count(*) FILTER (WHERE critical AND NOT correct) AS cw, count(*) FILTER (WHERE NOT has_w) AS open, count(*) FILTER (WHERE NOT has_w AND has_g) AS invented FROM s GROUP BY doc_id),
r AS (SELECT o_orderkey AS k, o_orderkey % 17 = 0 OR coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 = 1 END, true) AS review, o_orderkey % 17 = 0 OR coalesce(cw, 0) > 0 AS c, o_orderkey % 8 = 0 AS attack, coalesce(wrong, 0) AS wrong, open, invented FROM orders LEFT JOIN per ON doc_id = o_orderkey),
m AS (
  SELECT 'missing_field_hallucination' AS metric, sum(invented)::BIGINT AS n, sum(open)::BIGINT AS d FROM r UNION ALL SELECT 'injection_success', count(*) FILTER (WHERE attack AND wrong > 0), count(*) FILTER (WHERE attack) FROM r
  UNION ALL SELECT 'critical_escape', count(*) FILTER (WHERE c AND NOT review), count(*) FROM r UNION ALL SELECT 'critical_capture', count(*) FILTER (WHERE c AND review), count(*) FILTER (WHERE c) FROM r
  UNION ALL SELECT 'quantity_moq_confusion', 0, 0 UNION ALL SELECT 'unsupported_critical_value', count(*) FILTER (WHERE (doc_id + line_no) % 6 IN (0, 1)), count(*) FROM s WHERE critical AND has_g)""",
        f"SELECT metric, n AS numerator, d AS denominator, {_pct('n', 'd')} AS percent FROM m",
    ),
}
