"""Comparison of all quotes of all requests: findings, eligibility, factors, ranking, savings.

Findings are rules as data: code, severity, condition and message over one row of quotes or of lines. All rules of a
level are one projection; adding a rule adds no pass over the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.numbers import money
from bidlake.operators.pricing import ORG, increased, line_total, on_time, price_history, quote_totals, tier_mismatch

BLOCKING, WARNING = "blocking", "warning"
#: Findings that take a quote out of the comparison of totals.
NOT_COMPARABLE = ("INCOMPLETE_SCOPE", "QUANTITY_MISMATCH", "UOM_MISMATCH", "UNMATCHED_ITEM")
WINDOWS = (183, 92)


@dataclass
class Comparison:
    quotes: DataFrame
    lines: DataFrame
    findings: DataFrame
    requests: DataFrame


def _rows(df: DataFrame, keys: list[str], rules: list[tuple[str, str, Column, Column]]) -> DataFrame:
    """A row for each rule that a row breaks."""
    hits = [F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message"))) for code, severity, when, text in rules]
    return df.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("f")).select(*keys, "f.*")


def quote_rules(as_of: Column) -> list[tuple[str, str, Column, Column]]:
    c, text = F.col, F.lit
    empty = lambda x: F.coalesce(c(x), F.lit("")) == ""
    return [
        ("UNMATCHED_SUPPLIER", BLOCKING, c("supplier_id").isNull(), text("The supplier has to be confirmed.")),
        ("MISSING_IDENTITY", BLOCKING, empty("supplier_name") | empty("quote_number"), text("The supplier's name or the quote's number is missing.")),
        ("CURRENCY_MISMATCH", BLOCKING, ~c("currency").eqNullSafe(c("rfq_currency")), F.format_string("%s is not the request's currency %s; nothing is converted.", "currency", "rfq_currency")),
        ("QUOTE_EXPIRED", BLOCKING, c("expiration_date") < as_of, F.format_string("The quote was valid until %s.", c("expiration_date").cast("string"))),
        ("MISSING_EXPIRATION", BLOCKING, c("expiration_date").isNull(), text("It is not known how long the quote is valid.")),
        ("LOW_EXTRACTION_CONFIDENCE", BLOCKING, (c("confidence") < F.lit("0.8").cast("decimal(5,4)")) & ~c("review_status").eqNullSafe("Reviewed"), text("The quote's data have to be verified.")),
        ("MISSING_COST", BLOCKING, c("shipping_cost").isNull() | c("tax").isNull(), text("Shipping or tax is unknown, so there is no total.")),
        ("DUPLICATE_QUOTE", BLOCKING, c("same_number") > 1, text("The supplier has another quote of this number.")),
        ("TOTAL_MISMATCH", BLOCKING, money(c("stated_subtotal")) != c("subtotal"), text("The stated subtotal is not the sum of the lines.")),
        ("TOTAL_MISMATCH", BLOCKING, money(c("stated_total")) != c("total"), text("The stated total is not the sum of all costs.")),
    ]


def line_rules() -> list[tuple[str, str, Column, Column]]:
    c = F.col
    label = F.coalesce("sku", "supplier_sku", F.lit("?"))
    say = lambda text: F.concat(label, F.lit(f": {text}"))
    whole = lambda x: F.format_number(F.col(x).cast("decimal(18,0)"), 0)
    empty = lambda x: F.coalesce(c(x), F.lit("")) == ""
    low = F.lit("0.8").cast("decimal(5,4)")
    weak = F.coalesce(c("confidence") < low, F.lit(False)) | F.coalesce(F.exists(F.map_values("source_references"), lambda e: F.coalesce(e["confidence"], F.lit(0)) < low), F.lit(False))
    rise = F.try_divide(c("unit_price") * c(f"n_{WINDOWS[0]}") - c(f"sum_{WINDOWS[0]}"), c(f"sum_{WINDOWS[0]}")) * 100
    return [
        ("MISSING_SKU", BLOCKING, empty("supplier_sku"), F.lit("A line has no part number.")),
        ("UNMATCHED_ITEM", BLOCKING, c("sku").isNull(), say("no item of the request.")),
        ("MISSING_PRICE", BLOCKING, c("unit_price").isNull(), say("no unit price.")),
        ("QUANTITY_MISMATCH", BLOCKING, c("quantity").isNull() | (c("quantity") != c("required")), say("another quantity than required.")),
        ("UOM_MISMATCH", BLOCKING, empty("uom") | (c("uom") != c("item_uom")), say("unit of measure unknown or another one.")),
        ("MISSING_MOQ", BLOCKING, c("moq").isNull(), say("minimum order quantity unknown.")),
        ("MOQ_CONFLICT", BLOCKING, c("moq") > c("required"), F.concat(label, F.lit(": at least "), whole("moq"), F.lit(" have to be ordered, "), whole("required"), F.lit(" are required."))),
        ("MISSING_LEAD_TIME", BLOCKING, c("lead_time_days").isNull(), say("no lead time.")),
        ("DELIVERY_RISK", BLOCKING, c("expected_delivery") > c("required_delivery"), F.concat(label, F.lit(": "), F.datediff("expected_delivery", "required_delivery").cast("string"), F.lit(" days late."))),
        ("LOW_EXTRACTION_CONFIDENCE", BLOCKING, weak & ~c("review_status").eqNullSafe("Reviewed"), say("data have to be verified.")),
        ("TIER_PRICE_MISMATCH", BLOCKING, tier_mismatch(c("price_tiers"), c("quantity"), c("unit_price")), say("not the price of exactly one quantity tier.")),
        ("TOTAL_MISMATCH", BLOCKING, money(c("stated_line_total")) != c("line_total"), say("the stated amount is not quantity times price.")),
        ("PRICE_INCREASE", WARNING, increased(c("unit_price"), c(f"sum_{WINDOWS[0]}"), c(f"n_{WINDOWS[0]}"), c("anomaly_threshold")), F.concat(label, F.format_string(": +%.1f%% over the average of six months.", rise.cast("double")))),
    ]


def compare_quotes(quotes: DataFrame, lines: DataFrame, rfqs: DataFrame, requirements: DataFrame, items: DataFrame, suppliers: DataFrame, history: DataFrame, settings: DataFrame, as_of: str) -> Comparison:
    """Compare the quotes of every request, all at once, as of a date; see README for the columns.

    A line's item counts only if the request requires it. A quote is eligible without blocking findings, with a total
    and a line. Totals are compared among quotes in the request's currency with a known total and the full scope.
    """
    today, rfq = F.lit(as_of).cast("date"), [ORG, "rfq_id"]
    req = requirements.groupBy(*rfq, "item_id").agg(F.min_by("quantity", "requirement_id").alias("required"), F.count("*").alias("requirements"))
    wanted = req.join(items.select(ORG, "item_id", "sku", F.col("uom").alias("item_uom")), [ORG, "item_id"])
    heads = rfqs.select(*rfq, F.col("currency").alias("rfq_currency"), "required_delivery")
    q = quotes.join(heads, rfq).join(quote_totals(quotes, lines), [ORG, "quote_id"])
    q = q.join(suppliers.select(ORG, "supplier_id", F.col("name").alias("catalog_name")), [ORG, "supplier_id"], "left")
    q = q.withColumn("same_number", F.count("*").over(Window.partitionBy(*rfq, "supplier_id", "quote_number")))

    of_quote = q.select(ORG, "quote_id", "rfq_id", "currency", "quote_date", "review_status", "required_delivery")
    own = lines.join(of_quote, [ORG, "quote_id"]).join(wanted, [*rfq, "item_id"], "left").join(settings.select(ORG, "anomaly_threshold"), [ORG])
    own = own.withColumn("line_total", line_total(F.col("quantity"), F.col("unit_price")))
    own = own.withColumn("expected_delivery", F.coalesce("delivery_date", F.date_add(today, F.col("lead_time_days"))))
    own = own.withColumn("probe_id", F.concat_ws("\x1f", ORG, "quote_id", "line_no"))
    known = history.where(F.col("date") <= today)
    probes = own.where("sku is not null").withColumn("as_of", F.least(F.coalesce("quote_date", today), today))
    own = own.join(price_history(probes, known, WINDOWS), "probe_id", "left").drop("probe_id")

    per_line = _rows(own, [*rfq, "quote_id", "line_no"], line_rules())
    counts = lines.groupBy(ORG, "quote_id", "item_id").agg(F.count("*").alias("quoted"))
    scope = of_quote.join(wanted, rfq).join(counts, [ORG, "quote_id", "item_id"], "left").where(~F.col("quoted").eqNullSafe(1))
    scope = scope.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("requirements").cast("int")))).select(
        *rfq, "quote_id", F.lit(None).cast("int").alias("line_no"), F.lit("INCOMPLETE_SCOPE").alias("code"), F.lit(BLOCKING).alias("severity"), F.concat("sku", F.lit(": not exactly one line.")).alias("message")
    )
    per_quote = _rows(q.withColumn("line_no", F.lit(None).cast("int")), [*rfq, "quote_id", "line_no"], quote_rules(today))
    findings = per_quote.unionByName(per_line).unionByName(scope)

    rolled = findings.groupBy(ORG, "quote_id").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == BLOCKING).alias("blocking"), F.count_if(F.col("code").isin(*NOT_COMPARABLE)).alias("outside"))
    timing = own.groupBy(ORG, "quote_id").agg(F.max("lead_time_days").alias("lead_time_days"), F.max("expected_delivery").alias("delivery_date"))
    needed = req.select(*rfq, "item_id")
    past = quotes.select(*rfq, "supplier_id").distinct().join(needed, rfq).join(known.select(ORG, "item_id", "supplier_id", "actual_delivery", "expected_delivery"), [ORG, "item_id", "supplier_id"])
    delivered = on_time(past, *rfq, "supplier_id")
    weights = settings.select(ORG, *(F.col(f"{x}_weight").alias(f"w_{x}") for x in ("price", "lead_time", "reliability", "fit")))
    s = q.join(rolled, [ORG, "quote_id"], "left").join(timing, [ORG, "quote_id"], "left").join(delivered, [*rfq, "supplier_id"], "left").join(weights, ORG)
    zero = lambda x: F.coalesce(x, F.lit(0))
    own_currency = F.col("currency").eqNullSafe(F.col("rfq_currency"))
    s = s.withColumn("eligible", (zero("blocking") == 0) & F.col("total").isNotNull() & (F.col("line_count") > 0))
    s = s.withColumn("comparable", own_currency & F.col("total").isNotNull() & (zero("outside") == 0))
    each = Window.partitionBy(*rfq)
    among = lambda x: F.when(F.col("comparable"), F.col(x))
    s = s.withColumn("lowest", F.coalesce(F.min(among("total")).over(each), F.lit(0).cast("decimal(18,2)")))
    s = s.withColumn("highest", F.coalesce(F.max(among("total")).over(each), F.lit(0).cast("decimal(18,2)")))
    s = s.withColumn("soonest", zero(F.min(among("lead_time_days")).over(each)))
    one, total = F.lit(1).cast("decimal(18,2)"), F.col("total")
    price = F.when(total > 0, F.least(one.cast("decimal(38,16)"), F.try_divide(F.col("lowest"), total).cast("decimal(38,16)"))).otherwise(one.cast("decimal(38,16)"))
    lead = F.least(one.cast("decimal(38,16)"), F.try_divide((F.col("soonest") + 1).cast("decimal(10,0)"), (F.col("lead_time_days") + 1).cast("decimal(10,0)")).cast("decimal(38,16)"))
    held = F.coalesce(F.try_divide(F.col("on_time").cast("decimal(10,0)"), F.col("orders").cast("decimal(10,0)")), F.lit("0.5").cast("decimal(2,1)"))
    points = lambda x, w: money(x.cast("decimal(20,16)") * F.col(w).cast("decimal(10,0)"))
    none = F.lit(0).cast("decimal(18,2)")
    s = s.withColumn("price_points", F.when(F.col("comparable"), points(price, "w_price")).otherwise(none))
    s = s.withColumn("lead_points", F.when(F.col("lead_time_days").isNotNull(), points(lead, "w_lead_time")).otherwise(none))
    s = s.withColumn("reliability_points", points(held, "w_reliability"))
    s = s.withColumn("fit_points", F.when(F.col("eligible"), F.col("w_fit").cast("decimal(18,2)")).otherwise(none))
    s = s.withColumn("score", F.when(own_currency, money(F.col("price_points") + F.col("lead_points") + F.col("reliability_points") + F.col("fit_points"))))
    s = s.withColumn("supplier_name", F.coalesce("catalog_name", "supplier_name"))
    s = s.withColumn("lowest_cost", F.col("comparable") & (total == F.col("lowest")))
    s = s.withColumn("fastest", F.col("comparable") & F.coalesce(F.col("lead_time_days") == F.col("soonest"), F.lit(False)))
    order = Window.partitionBy(*rfq, "eligible").orderBy(F.col("score").desc(), "total", "supplier_name", "created_at", "quote_id")
    s = s.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(order)))
    scored = s.select(
        *rfq, "quote_id", "supplier_id", "supplier_name", "currency", "line_count", "subtotal", "total", "lead_time_days", "delivery_date", "eligible", "comparable",
        zero("orders").alias("historical_orders"), zero("findings").alias("findings"), "price_points", "lead_points", "reliability_points", "fit_points", "score", "lowest_cost", "fastest", "rank", "highest",
    )
    first = F.min_by(F.struct("quote_id", "supplier_name", "score", "total", "highest"), F.when(F.col("rank") == 1, 1))
    per = scored.groupBy(*rfq).agg(F.count("*").alias("quotes"), F.count_if("eligible").alias("eligible"), F.count_distinct("supplier_id").alias("responses"), first.alias("w"))
    best = [F.col("w.quote_id").alias("recommended_quote_id"), F.col("w.supplier_name").alias("winner"), F.col("w.score").alias("winner_score"), F.col("w.total").alias("winner_total"), F.greatest(F.col("w.highest") - F.col("w.total"), none).alias("savings")]
    per = per.select(*rfq, "quotes", "eligible", "responses", *best)
    said = F.when(
        F.col("winner").isNotNull(),
        F.format_string("%s ranks first with %s of 100 points at %s %s.", "winner", F.col("winner_score").cast("string"), "currency", F.format_number("winner_total", 2)),
    ).otherwise("No quote meets all requirements yet; resolve the blocking findings first.")
    requests = rfqs.join(per, rfq, "left").select(
        *rfq, "currency", zero("quotes").alias("quotes"), zero(F.col("eligible")).alias("eligible"), zero("responses").alias("responses"), "recommended_quote_id", "winner", "winner_score", "winner_total", F.coalesce("savings", none).alias("savings"), said.alias("explanation"),
    )
    return Comparison(scored.drop("highest"), own, findings, requests)


def finding_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Findings that are new or gone between two states, by quote, code and message."""
    key = [ORG, "quote_id", "code", "message"]
    new = current.select(*key).distinct().join(previous.select(*key), key, "left_anti").withColumn("change", F.lit("CREATED"))
    gone = previous.select(*key).distinct().join(current.select(*key), key, "left_anti").withColumn("change", F.lit("RESOLVED"))
    return new.unionByName(gone)


def recommendation_gate(recommendations: DataFrame, rfqs: DataFrame, requests: DataFrame, quotes: DataFrame) -> DataFrame:
    """Why a recommendation may not be approved: the request has moved on, it is stale, the winner is another, or the
    quote is not reviewed; null if it may."""
    r = recommendations.join(rfqs.select(ORG, "rfq_id", F.col("revision").alias("rfq_revision")), [ORG, "rfq_id"], "left")
    r = r.join(requests.select(ORG, "rfq_id", F.col("recommended_quote_id").alias("winner_id")), [ORG, "rfq_id"], "left")
    r = r.join(quotes.select(ORG, "quote_id", "review_status"), [ORG, "quote_id"], "left")
    reason = (
        F.when(F.col("status") == "Stale", "STALE")
        .when(~F.col("revision").eqNullSafe(F.col("rfq_revision")), "REQUEST_CHANGED")
        .when(~F.col("winner_id").eqNullSafe(F.col("quote_id")), "WINNER_CHANGED")
        .when(~F.col("review_status").eqNullSafe("Reviewed"), "QUOTE_NOT_REVIEWED")
    )
    return r.select(*recommendations.columns, reason.alias("reason"))


def dashboard(rfqs: DataFrame, quotes: DataFrame, requests: DataFrame) -> DataFrame:
    """One row a tenant: open requests, quotes, quotes to review, answers awaited, savings in each request's currency."""
    by_rfq = quotes.groupBy(ORG, "rfq_id").agg(F.count_distinct("supplier_id").alias("n"))
    opened = rfqs.join(by_rfq, [ORG, "rfq_id"], "left").groupBy(ORG).agg(
        F.count_if(F.col("status") == "Open").alias("open_rfqs"), F.sum(F.greatest(F.col("supplier_count") - F.coalesce("n", F.lit(0)), F.lit(0))).alias("awaiting")
    )
    seen = quotes.groupBy(ORG).agg(F.count("*").alias("quotes"), F.count_if(F.col("review_status") != "Reviewed").alias("needs_review"))
    saved = requests.groupBy(ORG, "currency").agg(F.sum("savings").alias("savings"), F.count("*").alias("n"))
    primary = saved.groupBy(ORG).agg(F.max_by(F.struct("currency", "savings"), F.struct("n", "currency")).alias("p"))
    return opened.join(seen, ORG, "left").join(primary.select(ORG, F.col("p.currency").alias("currency"), F.col("p.savings").alias("savings")), ORG, "left")
