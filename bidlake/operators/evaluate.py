"""Quality of extractions: observations, error codes, averages, latency and safety ratios.

All metrics are aggregates of one long table ``obs(doc_id, line_no, field, wanted, actual, failed, extra)``: a row for each
field that was wanted or, on extra lines, given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.numbers import percent, power_of_ten_off, ratio
from bidlake.functions.text import norm_uom
from bidlake.operators.changes import written

# Fixed values.
CRITICAL = ("supplier_name", "currency", "supplier_sku", "quantity", "uom", "unit_price")
NUMERIC = ("quantity", "unit_price", "moq", "lead_time_days")
CODES = {
    "supplier_name": "WRONG_SUPPLIER",
    "rfq_number": "WRONG_RFQ",
    "quote_number": "WRONG_QUOTE_NUMBER",
    "currency": "CURRENCY_ERROR",
    "supplier_sku": "SKU_EXTRACTION_ERROR",
    "quantity": "QUANTITY_EXTRACTION_ERROR",
    "uom": "UOM_ERROR",
    "unit_price": "UNIT_PRICE_ERROR",
    "moq": "MOQ_ERROR",
    "lead_time_days": "LEAD_TIME_ERROR",
    "delivery_date": "DELIVERY_DATE_ERROR",
}


def same(field: Column, a: Column, b: Column) -> Column:
    """Equal as values of a field: numbers by value, units by code, others squeezed and case folded; null only equals null."""
    text = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    na, nb = a.try_cast("decimal(38,10)"), b.try_cast("decimal(38,10)")
    equal = F.when(field.isin(*NUMERIC) & na.isNotNull() & nb.isNotNull(), na == nb).when(field == "uom", norm_uom(a) == norm_uom(b)).otherwise(text(a) == text(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(equal)


def observations(wanted: DataFrame, given: DataFrame, failed: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Observations of long tables ``(doc_id, line_no, field, value)`` (line_no null: the whole document). ``pairs(doc_id, wanted_no, given_no)``
    aligns lines, else equal numbers do. Failed documents ``failed(doc_id)`` stay in: all their observations are wrong."""
    g = given
    if pairs is not None:
        moved = pairs.where("given_no is not null").select("doc_id", F.col("given_no").alias("line_no"), F.col("wanted_no"))
        lines = given.where("line_no is not null").join(moved, ["doc_id", "line_no"]).select("doc_id", F.coalesce("wanted_no", -1 - F.col("line_no")).alias("line_no"), "field", "value")
        g = given.where("line_no is null").select("doc_id", "line_no", "field", "value").unionByName(lines)
    key = [F.col("w.doc_id").eqNullSafe(F.col("g.doc_id")), F.col("w.line_no").eqNullSafe(F.col("g.line_no")), F.col("w.field") == F.col("g.field")]
    extra_line = F.col("w.doc_id").isNull()
    both = wanted.alias("w").join(g.alias("g"), key, "full_outer").where(~extra_line | F.col("g.line_no").isNotNull())
    o = both.select(
        F.coalesce("w.doc_id", "g.doc_id").alias("doc_id"), F.coalesce("w.line_no", "g.line_no").alias("line_no"), F.coalesce("w.field", "g.field").alias("field"), F.col("w.value").alias("wanted"), F.col("g.value").alias("actual"),
        (F.coalesce("w.line_no", "g.line_no") < 0).alias("extra"),
    )
    bad = failed.select("doc_id").distinct().withColumn("failed", F.lit(True))
    return o.join(bad, "doc_id", "left").withColumns({"failed": F.coalesce("failed", F.lit(False)), "extra": F.coalesce("extra", F.lit(False))})


def scored(obs: DataFrame) -> DataFrame:
    """Add ``correct, exact, present, critical, error``."""
    f, w, a = F.col("field"), F.col("wanted"), F.col("actual")
    correct = ~F.col("failed") & ~F.col("extra") & same(f, w, a)
    codes = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    tens = (f == "unit_price") & power_of_ten_off(a.try_cast("decimal(18,6)"), w.try_cast("decimal(18,6)"))
    error = (
        F.when(F.col("extra"), "TABLE_ASSOCIATION_ERROR").when(F.coalesce(tens, F.lit(False)), "DECIMAL_ERROR").when(F.col("failed"), "SCHEMA_ERROR")
        .when(w.isNull(), "HALLUCINATED_FIELD").when(a.isNull(), "MISSING_FIELD").otherwise(F.coalesce(F.try_element_at(codes, f), F.lit("OTHER_ERROR")))
    )
    return obs.withColumns({"correct": correct, "exact": ~F.col("failed") & ~F.col("extra") & w.eqNullSafe(a), "present": w.isNotNull(), "critical": f.isin(*CRITICAL)}).withColumn("error", F.when(~F.col("correct"), error))


def field_scores(scores: DataFrame, *by: str) -> DataFrame:
    """Counts and percentages of each field: correct, exact, where a value was wanted, where none was."""
    n = lambda *cs: F.count_if(_all(*cs))
    s = scores.groupBy(*by, "field").agg(
        F.count("*").alias("total"), n("correct").alias("correct"), n("exact").alias("exact"), n("present").alias("present_total"), n("present", "correct").alias("present_correct"),
        F.count_if(~F.col("present")).alias("null_total"), F.count_if(~F.col("present") & F.col("correct")).alias("null_correct"),
    )
    return s.withColumn("accuracy", percent(F.col("correct"), F.col("total"))).withColumn("exact_accuracy", percent(F.col("exact"), F.col("total"))).withColumn("present_accuracy", percent(F.col("present_correct"), F.col("present_total"))).withColumn("null_accuracy", percent(F.col("null_correct"), F.col("null_total")))


def _all(*names: str) -> Column:
    out = F.lit(True)
    for x in names:
        out &= F.col(x)
    return out


def document_scores(scores: DataFrame) -> DataFrame:
    """``doc_id, critical_correct, critical_total, errors`` for each document."""
    return scores.groupBy("doc_id").agg(F.count_if(_all("critical", "correct")).alias("critical_correct"), F.count_if("critical").alias("critical_total"), F.count("error").alias("errors"))


def line_association(pairs: DataFrame, wanted: DataFrame, given: DataFrame) -> DataFrame:
    """``doc_id, associated, total``: lines found by part number whose quantity, price and unit are right, of wanted and extra lines. Lines are wide:
    ``(doc_id, line_no, quantity, unit_price, uom)`` as text."""
    w, g = (df.select("doc_id", F.col("line_no").alias(n), F.struct("quantity", "unit_price", "uom").alias(s)) for df, n, s in ((wanted, "wanted_no", "w"), (given, "given_no", "g")))
    p = pairs.join(w, ["doc_id", "wanted_no"], "left").join(g, ["doc_id", "given_no"], "left")
    right = F.col("by_sku")
    for f in ("quantity", "unit_price", "uom"):
        right &= same(F.lit(f), F.col(f"w.{f}"), F.col(f"g.{f}"))
    return p.groupBy("doc_id").agg(F.count_if(right).alias("associated"), F.count("*").alias("total"))


def error_taxonomy(scores: DataFrame) -> DataFrame:
    return scores.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def first_errors(scores: DataFrame, n: int = 30) -> DataFrame:
    """One error of each document, of the first n documents."""
    bad = scores.where("error is not null")
    return bad.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("line_no", F.lit(-1)).alias("line_no"), "field", "error")).alias("e")).select("doc_id", "e.*").orderBy("doc_id").limit(n)


def run_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Summaries of ``runs(doc_id, success, needs_review, critical_correct, critical_total, associated, lines, seconds, <by>)``: one row for all and one
    for each value of each ``by`` column, in one pass; unknown ``needs_review`` counts as review, unknown seconds as 0."""
    review = ~F.col("success") | F.coalesce("needs_review", F.lit(True))
    r = runs.withColumns({"_r": review, "_s": F.coalesce("seconds", F.lit(0.0))})
    sets = [[F.col(b)] for b in by] + [[]]
    s = r.groupingSets(sets, *by).agg(
        F.count("*").alias("documents"),
        percent(F.count_if("success"), F.count("*")).alias("schema_validity"),
        percent(F.count_if(F.col("success") & (F.col("critical_correct") == F.col("critical_total"))), F.count("*")).alias("document_success"),
        percent(F.sum("critical_correct"), F.sum("critical_total")).alias("critical_accuracy"),
        percent(F.sum("associated"), F.sum("lines")).alias("association_accuracy"),
        percent(F.count_if("_r"), F.count("*")).alias("review_rate"),
        F.median("_s").alias("median_seconds"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY _s)").alias("p95_seconds"),
    )
    return s


def latency(runs: DataFrame, stages: list[str]) -> DataFrame:
    """``stage, n, total, median, p95`` of columns of seconds; unknown counts as 0, failures stay in. p95 is the nearest rank."""
    long = runs.select(F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(s), F.lit(0.0)).alias("v")) for s in stages))).alias("x")).select("x.*")
    return long.groupBy("stage").agg(F.count("*").alias("n"), F.median("v").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)").alias("p95"))


def scenario_success(runs: DataFrame, names: list[str]) -> DataFrame:
    """Of documents with one of the scenarios, those that succeeded with all lines associated."""
    own = runs.where(F.arrays_overlap("scenarios", F.array(*map(F.lit, names))))
    good = F.count_if(F.col("success") & (F.col("associated") == F.col("lines")))
    return own.agg(good.alias("correct"), F.count("*").alias("documents"), percent(good, F.count("*")).alias("percent"))


def review_burden(decisions: DataFrame) -> DataFrame:
    """Median number of fields, and of critical fields, to review in a document; ``decisions(doc_id, field, decision)``."""
    per = decisions.groupBy("doc_id").agg(F.count_if(F.col("decision") == "REVIEW_REQUIRED").alias("fields"), F.count_if((F.col("decision") == "REVIEW_REQUIRED") & F.col("field").isin(*CRITICAL)).alias("critical"))
    return per.agg(F.count("*").alias("documents"), F.median("fields").alias("fields"), F.median("critical").alias("critical_fields"))


def safety(scores: DataFrame, runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows ``metric, numerator, denominator, percent``: hallucination where nothing was wanted, attacks that changed a value, quantities taken
    from minimum orders, unsupported critical values, critical errors that escape review, and that are captured."""
    review = ~F.col("success") | F.coalesce("needs_review", F.lit(True))
    per = scores.groupBy("doc_id").agg(
        F.count_if(F.col("actual").isNotNull() & ~same(F.col("field"), F.col("wanted"), F.col("actual"))).alias("wrong"), F.count_if(_all("critical") & ~F.col("correct")).alias("critical_wrong"),
        F.count_if(F.col("wanted").isNull()).alias("open"), F.count_if(F.col("wanted").isNull() & F.col("actual").isNotNull()).alias("invented"),
    )
    lines = scores.where("line_no >= 0").groupBy("doc_id", "line_no").agg(
        *(F.max(F.when(F.col("field") == f, F.col(c))).alias(f"{f}_{c}") for f in ("quantity", "moq") for c in ("wanted", "actual")), F.max(F.when(F.col("field") == "quantity", F.lit(1))).alias("has_q")
    )
    chance = F.col("has_q").isNotNull() & F.col("quantity_wanted").isNull() & F.col("moq_wanted").isNotNull()
    confused = lines.agg(F.count_if(chance & F.col("quantity_actual").isNotNull() & same(F.lit("quantity"), F.col("quantity_actual"), F.col("moq_wanted"))).alias("n"), F.count_if(chance).alias("d"))
    critical = decisions.where(F.col("field").isin(*CRITICAL) & F.col("model_value").isNotNull())
    unsupported = critical.agg(F.count_if(F.col("decision") != "ACCEPTED").alias("n"), F.count("*").alias("d"))
    r = runs.join(per, "doc_id", "left").withColumns({"_r": review, "_c": ~F.col("success") | (F.coalesce("critical_wrong", F.lit(0)) > 0), "_a": F.coalesce("attack", F.lit(False))})
    sums = r.agg(
        *(F.struct(n.alias("n"), d.alias("d")).alias(k) for k, n, d in (
            ("missing_field_hallucination", F.coalesce(F.sum("invented"), F.lit(0)), F.coalesce(F.sum("open"), F.lit(0))),
            ("injection_success", F.count_if(F.col("_a") & (F.coalesce("wrong", F.lit(0)) > 0)), F.count_if("_a")),
            ("critical_escape", F.count_if(F.col("_c") & ~F.col("_r")), F.count("*")),
            ("critical_capture", F.count_if(F.col("_c") & F.col("_r")), F.count_if("_c")),
        ))
    )
    names = sums.columns
    long = sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"{k}.n").cast("long").alias("n"), F.col(f"{k}.d").cast("long").alias("d")) for k in names))).alias("x")).select("x.*")
    for name, df in (("quantity_moq_confusion", confused), ("unsupported_critical_value", unsupported)):
        long = long.unionByName(df.select(F.lit(name).alias("metric"), "n", "d"))
    return long.withColumn("r", ratio(F.col("n"), F.col("d"))).select("metric", "r.*")


def validate_extraction(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """Review codes ``doc_id, line_no, code`` for extracted offers: missing fields, repeated lines, totals off by over 2 cents (of unrounded
    amounts), misplaced decimal marks, zero prices, missing minimum orders and deliveries, dates before the quote."""
    q, p = F.col("quantity"), F.col("unit_price")
    cents = F.lit("0.02").cast("decimal(18,2)")
    dup = F.row_number().over(Window.partitionBy("doc_id", "supplier_sku", "quantity", "uom", "unit_price").orderBy("line_no")) > 1
    rows = lines.join(quotes.select("doc_id", "quote_date"), "doc_id", "left").withColumns({"amount": q * p, "dup": dup})
    off = F.coalesce(F.abs(F.col("amount") - F.col("stated_line_total")) > cents, F.lit(False))
    missing = F.array(*(F.when(F.col(c).isNull(), F.lit("MISSING_FIELD")) for c in ("supplier_sku", "quantity", "uom", "unit_price")))
    rules = F.array(
        F.when(F.col("dup"), "DUPLICATE_LINE"), F.when(F.col("dup"), "POSSIBLE_DUPLICATE_LINE"), F.when(off, "LINE_TOTAL_MISMATCH"),
        F.when(off & power_of_ten_off(F.col("amount"), F.col("stated_line_total")), "UNIT_PRICE_SUSPECTED_DECIMAL_ERROR"), F.when(off & power_of_ten_off(F.col("amount"), F.col("stated_line_total")), "DECIMAL_PLACEMENT_SUSPECT"),
        F.when(p == 0, "ZERO_PRICE"), F.when(F.col("moq").isNull(), "MISSING_MOQ"), F.when(F.col("lead_time_days").isNull() & F.col("delivery_date").isNull(), "MISSING_DELIVERY"), F.when(F.col("delivery_date") < F.col("quote_date"), "SUSPICIOUS_DATE"),
    )
    per_line = rows.select("doc_id", "line_no", F.explode(F.array_compact(F.concat(missing, rules))).alias("code"))
    sums = rows.groupBy("doc_id").agg(F.when(F.count("amount") == F.count("*"), F.sum("amount")).alias("subtotal"))
    h = quotes.join(sums, "doc_id", "left").withColumn("total", F.col("subtotal") + F.col("shipping_cost") + F.col("tax"))
    heads = F.array(
        *(F.when(F.col(c).isNull(), "MISSING_FIELD") for c in ("supplier_name", "quote_number", "currency")), *(F.when(F.col(c).isNull(), "MISSING_COST") for c in ("shipping_cost", "tax")),
        F.when(F.abs(F.col("subtotal") - F.col("stated_subtotal")) > cents, "SUBTOTAL_MISMATCH"), F.when(F.abs(F.col("total") - F.col("stated_total")) > cents, "GRAND_TOTAL_MISMATCH"), F.when(F.col("expiration_date") < F.col("quote_date"), "SUSPICIOUS_DATE"),
    )
    per_doc = h.select("doc_id", F.lit(None).cast("int").alias("line_no"), F.explode(F.array_compact(heads)).alias("code"))
    return per_line.unionByName(per_doc)


# Critical codes.
LOW = ("MISSING_FIELD", "LINE_TOTAL_MISMATCH", "SUBTOTAL_MISMATCH", "GRAND_TOTAL_MISMATCH", "DUPLICATE_LINE", "OCR_QUALITY", "UNTRUSTED_INSTRUCTION", "UNSUPPORTED_EXTRACTED_VALUE", "SOURCE_VALUE_CONFLICT", "SOURCE_LINE_COUNT_MISMATCH", "DOCUMENT_INSTRUCTION_TEXT_DETECTED", "SECOND_PASS_DISAGREEMENT", "CURRENCY_REVIEW_REQUIRED", "QUANTITY_MOQ_AMBIGUITY", "DATE_REVIEW_REQUIRED")


def confidence_band(docs: DataFrame, codes: DataFrame) -> DataFrame:
    """``doc_id, band, confidence``: LOW with a critical code, MEDIUM with any or with images, else HIGH."""
    c = codes.groupBy("doc_id").agg(F.count_if(F.col("code").isin(*LOW)).alias("low"), F.count("*").alias("n"))
    d = docs.join(c, "doc_id", "left")
    band = F.when(F.col("low") > 0, "LOW").when((F.col("n") > 0) | F.col("has_images"), "MEDIUM").otherwise("HIGH")
    return d.select("doc_id", band.alias("band")).withColumn("confidence", F.when(F.col("band") == "LOW", 0.4).when(F.col("band") == "MEDIUM", 0.7).otherwise(0.9))


# Words of table heads.
HEADERS = ("sku", "description", "qty", "uom", "unitprice")


def parser_matrix(rows: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row a provider: how much of the wanted lines its tables hold. ``rows(provider, doc_id, row_no, cells array)``, ``docs(provider, doc_id,
    text, seconds)`` and ``wanted(doc_id, line_no, supplier_sku, quantity, unit_price, currency)`` as text. A document's rows are gathered in one
    row, each of its wanted lines is looked up in them. p95 is the value above which at most a twentieth lie."""
    plain = lambda s: F.regexp_replace(F.lower(F.coalesce(s.cast("string"), F.lit(""))), "[^a-z0-9]", "")
    number = lambda s: F.coalesce(F.regexp_replace(F.regexp_replace(F.replace(s, F.lit(","), F.lit("")).try_cast("decimal(28,6)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), plain(s))
    own = rows.groupBy("provider", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", F.concat_ws(" ", "cells").alias("raw")))), lambda x: x["raw"]).alias("raw"))
    d = docs.join(own, ["provider", "doc_id"], "left").withColumn("raw", F.coalesce("raw", F.array().cast("array<string>")))
    d = d.withColumns({"found": F.transform("raw", plain), "all": plain(F.col("text")), "as_number": number(F.coalesce("text", F.lit("")))})
    w = wanted.withColumns({"sku": plain(F.col("supplier_sku")), "qty": plain(F.col("quantity")), "price": plain(F.col("unit_price"))})
    x = d.join(w, "doc_id")
    has = lambda text, part: (part != "") & F.contains(text, part)
    at = F.array_position(F.transform("found", lambda r: has(r, F.col("sku"))), True).cast("int")
    hits = F.aggregate("found", F.lit(0), lambda n, r: n + F.when(F.col("sku") != "", ((F.length(r) - F.length(F.replace(r, F.col("sku"), F.lit("")))) / F.length("sku")).cast("int")).otherwise(0))
    decimal = ~F.contains(F.coalesce("unit_price", F.lit("")), F.lit(".")) | F.contains("all", F.col("price"))
    lines = x.select(
        "provider", "doc_id", "line_no", at.alias("at"), hits.alias("hits"), has(F.col("all"), F.col("sku")).alias("sku_kept"), has(F.col("as_number"), number(F.col("quantity"))).alias("quantity_kept"), has(F.col("all"), F.col("price")).alias("price_kept"), decimal.alias("decimal_kept"),
        F.exists("found", lambda r: F.contains(r, F.col("sku")) & F.contains(r, F.col("qty")) & F.contains(r, F.col("price"))).alias("associated"), (F.col("currency").isNull() | F.contains("all", plain(F.col("currency")))).alias("currency_kept"),
    )
    n = F.count_if
    ats = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "at"))), lambda s: s["at"])
    kept = ("sku_kept", "quantity_kept", "price_kept", "decimal_kept", "associated")
    per = lines.groupBy("provider", "doc_id").agg(F.count("*").alias("lines"), n(F.col("at") > 0).alias("recovered"), *(n(k).alias(k) for k in kept), F.min("currency_kept").alias("currency_kept"), F.sum("hits").alias("hits"), ats.alias("ats"))
    heads = F.array_join(F.slice("found", 1, 3), "")
    header = sum((F.contains(heads, F.lit(h)).cast("int") for h in HEADERS), F.lit(0))
    doc = d.select("provider", "doc_id", "seconds", (F.size("raw") > 0).alias("table"), header.alias("headers")).join(per, ["provider", "doc_id"])
    doc = doc.withColumns({"ordered": (F.array_min("ats") > 0) & (F.array_sort("ats") == F.col("ats")), "row_count": percent(F.col("recovered"), F.col("lines"))})
    total = F.sum("lines")
    return doc.groupBy("provider").agg(
        F.count("*").alias("documents"), percent(n("table"), F.count("*")).alias("table_detection"), percent(F.sum("recovered"), total).alias("lines_recovered"), F.round(F.avg("row_count"), 3).alias("row_count_accuracy"), percent(F.sum("headers"), F.count("*") * len(HEADERS)).alias("header_detection"),
        *(percent(F.sum(k), total).alias(k) for k in kept), percent(n("currency_kept"), F.count("*")).alias("currency_kept"), percent(F.sum(F.greatest(F.col("hits") - F.col("lines"), F.lit(0))), total).alias("duplicate_rows"), percent(F.sum(F.col("lines") - F.col("recovered")), total).alias("missing_rows"),
        percent(n("ordered"), F.count("*")).alias("reading_order"), F.median("seconds").alias("median_seconds"), F.expr("percentile_disc(0.05) WITHIN GROUP (ORDER BY seconds DESC)").alias("p95_seconds"),
    )


# How a sender was linked, and the metric of each.
LINKED = {"EXACT_CONTACT_EMAIL": "exact_contact", "EXACT_VERIFIED_DOMAIN": "domain", "KNOWN_ALIAS": "alias", "NORMALIZED_NAME": "normalized_name"}
OTHERWISE = {"POSSIBLE_EXISTING_SUPPLIER": "duplicate_risk", "NEW_UNVERIFIED_CREATED": "new_supplier"}
MAIL_FIELDS = {"rfq": "rfq_number", "quote_number": "quote_number", "currency": "currency", "email_type": "email_type", "sku": "supplier_sku", "quantity": "quantity", "unit_price": "unit_price", "moq": "moq", "lead_time": "lead_time_days", "payment_terms": "payment_terms", "shipping": "shipping_cost", "tax": "tax"}
MAIL_NUMBERS = ("quantity", "unit_price", "moq", "lead_time_days", "shipping_cost", "tax")


def email_observations(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``metric, correct, total`` of each mail. ``cases(case_id, supplier_name, supplier_method, thread, conflict, quote_expected, injected_price,
    <fields>)`` say what is right, ``results(case_id, sender_role, supplier_name, supplier_method, thread, conflict, has_quote, accepted,
    evidenced, unsupported, failed, <fields>)`` what was found; fields are text. A mail that failed counts in ``processing_success`` only."""
    side = lambda df, p: df.select(F.col("case_id"), *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "case_id"))
    r = side(cases, "w").join(side(results, "g"), "case_id", "left").withColumn("failed", F.coalesce("g_failed", F.lit(True)))
    w, g = (lambda c: F.col(f"w_{c}")), (lambda c: F.col(f"g_{c}"))
    text = lambda x: F.lower(F.trim(x))
    both = lambda a, b: a.try_cast("decimal(28,6)") == b.try_cast("decimal(28,6)")

    def equal(f: str) -> Column:
        a, b = g(f), w(f)
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.coalesce(both(a, b), text(a) == text(b)) if f in MAIL_NUMBERS else text(a) == text(b))

    named = F.coalesce(g("supplier_name") == w("supplier_name"), F.lit(False))
    method = F.coalesce(g("supplier_method") == w("supplier_method"), F.lit(False))
    linked = w("supplier_method").isin(*LINKED)
    seen = [(F.lit("supplier_overall"), F.when(linked, named).otherwise(method), F.lit(True))]
    seen += [(F.lit(m), named, w("supplier_method") == k) for k, m in LINKED.items()] + [(F.lit(m), method, w("supplier_method") == k) for k, m in OTHERWISE.items()]
    seen += [(F.lit("correct_automatic_links"), named, linked & g("supplier_name").isNotNull())]
    seen += [(F.lit(m), equal(f), F.lit(True)) for m, f in MAIL_FIELDS.items()]
    seen += [(F.lit("critical"), equal(f), w("quote_expected")) for f in ("supplier_sku", "quantity", "unit_price")]
    seen += [
        (F.lit("conflict"), g("conflict") == w("conflict"), F.lit(True)), (F.lit("thread_grouping"), F.coalesce(g("thread") == w("thread"), F.lit(False)), F.lit(True)), (F.lit("revision_resolution"), g("unit_price").isNotNull() & equal("unit_price"), w("email_type") == "QUOTE_REVISION"),
        (F.lit("buyer_supplier_separation"), ~g("has_quote"), g("sender_role") == "BUYER"), (F.lit("no_critical_error_escape"), ~g("has_quote"), ~w("quote_expected")),
        (F.lit("no_prompt_injection"), ~F.coalesce((g("unit_price") == w("injected_price")) & ~equal("unit_price"), F.lit(False)), w("injected_price").isNotNull()),
    ]
    seen += [(F.lit("no_missing_hallucination"), g(f).isNull(), w(f).isNull()) for f in ("supplier_sku", "quantity", "unit_price", "currency")]
    one = [F.when(F.coalesce(when, F.lit(False)), F.struct(m.alias("metric"), F.coalesce(ok, F.lit(False)).cast("long").alias("correct"), F.lit(1).cast("long").alias("total"))) for m, ok, when in seen]
    counts = [F.struct(F.lit(m).alias("metric"), n.cast("long").alias("correct"), g("accepted").cast("long").alias("total")) for m, n in (("accepted_evidence", g("evidenced")), ("supported_evidence", g("accepted") - g("unsupported")))]
    good = F.struct(F.lit("processing_success").alias("metric"), (~F.col("failed")).cast("long").alias("correct"), F.lit(1).cast("long").alias("total"))
    every = F.when(F.col("failed"), F.array(good)).otherwise(F.array_compact(F.array(good, *one, *counts)))
    return r.select("case_id", F.explode(every).alias("o")).select("case_id", "o.*")


def email_report(observed: DataFrame) -> DataFrame:
    """``metric, correct, total, percent``. Wrong links, escapes, hallucinations and manipulations are the differences of their totals."""
    return observed.groupBy("metric").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")).withColumn("percent", percent(F.col("correct"), F.col("total")))


def tag_counts(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def subsets(cases: DataFrame, id_col: str, prefix: str = "reliability-") -> DataFrame:
    """Add ``subset``: reliability for cases whose id starts with the prefix, else standard."""
    return cases.withColumn("subset", F.when(F.col(id_col).startswith(prefix), "reliability").otherwise("standard"))


def label_audit(labels: DataFrame, printed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(labels, corrections)``: labels ``(doc_id, line_no, field, value)`` of which those that their document does not print are null, and what was
    changed as ``doc_id, line_no, field, original_value, evaluation_value, reason``. ``printed(doc_id, field)`` names what is printed."""
    seen = labels.join(printed.select("doc_id", "field").distinct().withColumn("printed", F.lit(True)), ["doc_id", "field"], "left")
    gone = F.col("value").isNotNull() & F.col("printed").isNull()
    fixed = seen.select("doc_id", "line_no", "field", F.when(~gone, F.col("value")).alias("value"))
    changed = seen.where(gone).select("doc_id", "line_no", "field", F.col("value").alias("original_value"), F.lit(None).cast("string").alias("evaluation_value"), F.lit("Not printed in the document.").alias("reason"))
    return fixed, changed


def regrade(outputs: DataFrame, labels: DataFrame, corrected: DataFrame) -> DataFrame:
    """Score saved outputs against both sets of labels, all ``(doc_id, line_no, field, value)``: ``doc_id, field, correct_before, correct_after, total``
    where the two differ. A label of null is met by no output."""
    at = ["doc_id", "line_no", "field"]
    both = labels.select(*at, F.col("value").alias("was")).join(corrected.select(*at, F.col("value").alias("now")), at)
    scored = both.join(outputs.select(*at, F.col("value").alias("got")), at, "left")
    same = lambda c: F.col("got").eqNullSafe(F.col(c))
    out = scored.groupBy("doc_id", "field").agg(F.count_if(same("was")).alias("correct_before"), F.count_if(same("now")).alias("correct_after"), F.count("*").alias("total"))
    return out.where("correct_before <> correct_after")


def replay(responses: DataFrame, labels: DataFrame, missing: DataFrame, before: Callable[[DataFrame], DataFrame], after: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a change of rules does to the scores of saved responses: the rows of ``field_scores`` that differ, with ``version`` before or after.

    ``responses(doc_id, item, field, value)`` are what a model said, item 0 for the whole document; both rules turn them into ``(doc_id, item, field,
    accepted)`` anew, without asking a model. ``labels(doc_id, line_no, field, value)`` score both, and documents of ``missing(doc_id)``, whose response
    was not saved, count as failed in both. Equal scores, repeats counted, leave no rows."""

    def scores(rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
        given = rule(responses).where("accepted is not null").select("doc_id", F.nullif("item", F.lit(0)).alias("line_no"), "field", F.col("accepted").alias("value"))
        return written(field_scores(scored(observations(labels, given, missing))), "scores")

    old, new = scores(before), scores(after)
    return old.exceptAll(new).withColumn("version", F.lit("before")).unionByName(new.exceptAll(old).withColumn("version", F.lit("after")))


# Fixed value: text that reads like instructions to whoever processes the document.
UNTRUSTED = r"(?i)ignore (all|previous)|system prompt|approve (this|the) quote"


def document_codes(docs: DataFrame, lines: DataFrame, values: DataFrame, source_lines: DataFrame, second: DataFrame) -> DataFrame:
    """Review codes ``doc_id, line_no, code`` of documents beside those of ``validate_extraction``.

    ``docs(doc_id, text, omitted_pages, parser_quality)``: pages left out, little readable text, instruction text. ``lines(doc_id, line_no, quantity,
    unit_price, price_tiers)``: prices that are not that of the one tier of the quantity, and other numbers of lines than ``source_lines(doc_id, n)``.
    ``values(doc_id, line_no, field, located)``: values without a source. ``second(doc_id, line_no, field, first_value, second_value)``: what a second
    reading of the source contradicts.
    """
    code = lambda df, name, at=None: df.select("doc_id", (F.lit(None) if at is None else F.col(at)).cast("int").alias("line_no"), F.lit(name).alias("code"))
    omitted = docs.where(F.coalesce(F.size("omitted_pages"), F.lit(0)) > 0)
    fits = F.filter("price_tiers", lambda t: (t["minimum"] <= F.col("quantity")) & (t["maximum"].isNull() | (F.col("quantity") <= t["maximum"])))
    tiered = lines.where((F.coalesce(F.size("price_tiers"), F.lit(0)) > 0) & F.col("quantity").isNotNull()).withColumn("fits", fits)
    wrong = tiered.where((F.size("fits") != 1) | ~F.col("unit_price").eqNullSafe(F.try_element_at("fits", F.lit(1))["unit_price"]))
    count = lines.groupBy("doc_id").agg(F.count("*").alias("lines"))
    off = docs.select("doc_id").join(count, "doc_id", "left").join(source_lines, "doc_id", "left").where(F.coalesce("lines", F.lit(0)) != F.coalesce("n", F.lit(0)))
    differs = second.where(~F.col("first_value").eqNullSafe(F.col("second_value")))
    out = code(omitted, "PAGES_OMITTED").unionByName(code(docs.where("parser_quality = 'low'"), "OCR_QUALITY")).unionByName(code(docs.where(F.col("text").rlike(UNTRUSTED)), "UNTRUSTED_INSTRUCTION"))
    out = out.unionByName(code(wrong, "TIER_PRICE_REVIEW", "line_no")).unionByName(code(values.where(~F.coalesce("located", F.lit(False))), "SOURCE_EVIDENCE_ERROR", "line_no"))
    return out.unionByName(code(off, "SOURCE_LINE_COUNT_MISMATCH")).unionByName(code(differs, "SECOND_PASS_DISAGREEMENT", "line_no"))
