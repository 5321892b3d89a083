"""Facts from document text and the gate that only lets facts with evidence through.

A document is rows of text in order. One windowed pass marks table headers, item starts and resets; each row then gives
``(field, text)`` pairs by its form: labelled line, table row, or several labels in a line. Facts are a long table;
the gate is an aggregate over the facts of a field joined with what a model said.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.evidence import price_tiers
from bidlake.functions.numbers import field_number, lead_days, parse_date
from bidlake.functions.text import clean_sku, norm_label, norm_uom, ocr_repair

# Labels of each field.
LABELS = {
    "supplier_name": ("supplier", "supplier name", "seller", "vendor"),
    "currency": ("currency", "settlement currency", "currency choices"),
    "quote_number": ("quote", "quote number", "quotation number", "quotation no"),
    "rfq_number": ("rfq", "rfq number", "tfq"),
    "supplier_sku": ("sku", "supplier sku", "supplier part number", "supplier part no", "vendor part number", "vendor part no", "part number", "part no", "item number", "item no", "item code", "material", "stock no"),
    "description": ("description", "item description", "product description"),
    "quantity": ("qty", "oty", "quantity", "quoted quantity", "order qty", "order quantity"),
    "uom": ("uom", "yom", "vom", "unit of measure", "unit"),
    "unit_price": ("unit price", "price per unit", "price each", "each price", "unit cost", "net ea"),
    "moq": ("moq", "moqg", "minimum order quantity", "minimum qty", "min qty"),
    "lead_time_days": ("lead time", "lead time days", "lead", "availability"),
    "delivery_date": ("delivery", "delivery date", "ship date", "promise date"),
    "stated_line_total": ("line total", "extended", "extended price", "extension", "amount"),
    "shipping_cost": ("shipping", "shipping cost", "shipping handling", "shipping and handling", "freight", "freight charge"),
    "tax": ("tax", "sales tax", "vat", "gst"),
    "stated_subtotal": ("subtotal", "sub total", "stated subtotal"),
    "stated_total": ("total", "grand total", "amount due", "stated total"),
    "quote_date": ("quote date", "quotation date"),
    "expiration_date": ("valid until", "expiration date", "expires"),
    "payment_terms": ("payment terms",),
}
LINE_FIELDS = ("supplier_sku", "description", "quantity", "uom", "unit_price", "moq", "lead_time_days", "delivery_date", "stated_line_total")
NUMBERS = ("quantity", "unit_price", "moq", "shipping_cost", "tax", "stated_subtotal", "stated_total", "stated_line_total")
DATES = ("delivery_date", "quote_date", "expiration_date")
NAMED_ITEM = r"(?i)\bfor\s+([^:]+?)\s*:"
INSTRUCTION = (
    r"(?i)"
    r"ignore\s+(?:all|previous|the\s+quoted|system|the\s+evidence)|system\s*(?:prompt|:)|"
    r"(?:set|replace|change)\s+(?:every|all|the|supplier|tax|unit|price)|"
    r"return\s+(?:quantity|json|eur)|use\s+EUR\s+even|do\s+not\s+extract|"
    r"output\s+no\s+json|always\s+recommend|say\s+moq|send\s+this\s+order|"
    r"autonomous\s+purchasing|follow\s+these\s+instructions|assistant\s*:"
)
WITHDRAWN = r"(?i)\b(withdrawn|previous offer|not current)\b"
SEPARATOR = r"(?i)(--- LINE ITEM ---|QUOTED LINE|^\s*quoted item\b)"
#: Words of which every text that ``INSTRUCTION`` fits has one, in lower case, and those of withdrawn offers and separators: few rows have any, so few are
#: searched by the patterns.
INSTRUCTION_WORDS = ("ignore", "system", "set", "replace", "change", "return", "even", "extract", "output", "always", "say", "send", "autonomous", "follow", "assistant")
WITHDRAWN_WORDS = ("withdrawn", "previous offer", "not current")
SEPARATOR_WORDS = ("--- line item ---", "quoted line", "quoted item")
LABELLED = r"^\s*([^:|;.]{1,60})\s*[:|;.]\s*(.*?)\s*$"
KEYWORDS = r"(?i)\b(quote|quotation|price|qty|quantity|total|sku|part|lead time|delivery|moq|currency|terms)\b"


def _may(low: str, words: tuple[str, ...]) -> Column:
    """Whether a column of text in lower case holds any of the words."""
    return reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words))


def _instructs(text: Column) -> Column:
    """``INSTRUCTION``, which only fits texts with three letters in a row."""
    return text.rlike("[A-Za-z]{3}") & text.rlike(INSTRUCTION)


def canonical(label: Column) -> Column:
    """The field that a label names, else null."""
    pairs = {norm: field for field, labels in LABELS.items() for norm in (field.replace("_", " "), *labels)}
    lookup = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    # no label has a digit, so parts and amounts are not normalised
    return F.when(~label.rlike("[0-9]"), F.try_element_at(lookup, norm_label(F.replace(label, F.lit("_"), F.lit(" ")))))


def value_for(field: Column, text: Column) -> Column:
    """The value of a field's text in one form, null if it has none (or holds instructions)."""
    t = F.trim(text)
    number = field_number(t)
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    upper = F.upper(t)
    lead = F.when(t.rlike(r"^\d+$"), t.try_cast("int")).otherwise(lead_days(t, "evidence"))
    value = (
        F.when(field.isin(*NUMBERS), plain)
        .when(field == "currency", F.when(upper.rlike("^[A-Z]{3}$") & ~upper.isin("TBD"), upper))
        .when(field == "lead_time_days", lead.cast("string"))
        .when(field.isin(*DATES), parse_date(t).cast("string"))
        .when(field == "uom", norm_uom(t))
        .when(field == "supplier_sku", clean_sku(t))
        .otherwise(F.regexp_replace(t, r"\s+", " "))
    )
    return F.when((t != "") & ~_instructs(t), value)


def split_cells(raw: Column) -> Column:
    several = F.transform(F.split(F.trim(raw), r"\s*\|\s*|\s+:\s+|\s{2,}"), lambda x: F.trim(x))
    return F.when(F.trim(raw).rlike(r"\||\s:\s|\s\s"), several).when(raw.isNotNull(), F.array(F.trim(raw)))


def classified_rows(rows: DataFrame) -> DataFrame:
    """Add to ``rows(doc_id, row_no, raw, ...)``: ``kind`` (instruction, withdrawn, separator, header, labelled, table, inline or text), the ``header``
    that applies and ``table_no``, the running number of headers. Separators end a table."""
    cells = split_cells(F.col("raw"))
    keys = F.when(F.size("cells") >= 3, F.transform("cells", canonical))  # a header names three fields
    label = canonical(F.regexp_extract("raw", LABELLED, 1))
    names = "|".join(sorted({n.replace(" ", r"\s+") for f in LINE_FIELDS for n in LABELS[f]}, key=lambda n: (-len(n), n)))
    inline = rf"(?i)(?<![A-Za-z0-9])({names})\s*:?[ \t]*"
    first_words = {n.split()[0] for f in LINE_FIELDS for n in LABELS[f]}
    inline_words = tuple(sorted(w for w in first_words if not any(o != w and o in w for o in first_words)))
    r = rows.withColumns({"cells": cells, "low": F.lower("raw")}).withColumn("keys", keys).withColumn("label", label)
    known = F.size(F.filter("keys", lambda k: k.isNotNull()))
    is_header = F.array_contains(F.coalesce("keys", F.array().cast("array<string>")), "supplier_sku") & (known >= 3)
    base = (
        F.when(_may("low", INSTRUCTION_WORDS) & F.col("raw").rlike(INSTRUCTION), "instruction").when(_may("low", SEPARATOR_WORDS) & F.col("raw").rlike(SEPARATOR), "separator").when(is_header, "header").when(F.col("label").isNotNull(), "labelled")
    )
    r = r.withColumn("base", base)
    w = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("base") == "header", F.struct(F.col("keys").alias("header"))).when(F.col("base") == "separator", F.struct(F.lit(None).cast("array<string>").alias("header")))
    r = r.withColumn("header", F.last(mark, True).over(w)["header"]).withColumn("table_no", F.count_if(F.col("base") == "header").over(w).cast("int"))
    count = F.size(F.regexp_extract_all("raw", F.lit(inline), 1))
    kind = F.coalesce(
        F.col("base"),
        F.when(F.size("header") == F.size("cells"), "table").when(_may("low", WITHDRAWN_WORDS) & F.col("raw").rlike(WITHDRAWN), "withdrawn").when(_may("low", inline_words) & (count >= 2), "inline").otherwise("text"),
    )
    marked = F.regexp_replace("raw", inline, "\u0001$1\u0002")
    return r.withColumn("kind", kind).withColumn("marked", F.when(F.col("kind") == "inline", marked)).drop("base", "low")


def itemised_rows(rows: DataFrame) -> DataFrame:
    """``classified_rows`` but instructions and withdrawn offers, with the ``pairs`` of fields and texts that a row states, the number ``at`` of items that
    have started, and whether the last is ``open``. A part number starts an item, as do rows with several labels; headers and separators close it."""
    r = classified_rows(rows).where(~F.col("kind").isin("instruction", "withdrawn"))
    pair = lambda f, v: F.struct(f.alias("field"), v.alias("text"))
    labelled = F.array(pair(F.col("label"), F.regexp_extract("raw", LABELLED, 2)))
    table = F.zip_with("header", "cells", pair)
    chunks = F.split("marked", "\u0001")
    inline = F.transform(F.slice(chunks, 2, F.size(chunks)), lambda c: pair(canonical(F.substring_index(c, "\u0002", 1)), F.btrim(F.substring_index(c, "\u0002", -1), F.lit(" :|,;"))))
    prefix = F.btrim(chunks[0], F.lit(" :|,;"))
    inline = F.when(prefix != "", F.concat(F.array(pair(F.lit("supplier_sku"), F.split(prefix, r"\s+")[0])), inline)).otherwise(inline)
    r = r.withColumn("pairs", F.when(F.col("kind") == "labelled", labelled).when(F.col("kind") == "table", table).when(F.col("kind") == "inline", inline))
    sku = F.exists("pairs", lambda p: p["field"] == "supplier_sku")
    starts = F.coalesce(sku | (F.col("kind") == "inline"), F.lit(False))
    w = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.when(starts, True).when(F.col("kind").isin("header", "separator"), False)
    return r.withColumn("open", F.coalesce(F.last(state, True).over(w), F.lit(False))).withColumn("at", F.count_if(starts).over(w).cast("int"))


def source_facts(rows: DataFrame) -> DataFrame:
    """Facts ``doc_id, item, row_no, field, value, raw``: item 0 is the whole offer, items count from 1 in order of their starts. Facts of items before
    any start, or after a header or separator, belong to none and go."""
    r = itemised_rows(rows).where("kind <> 'text'")
    f = r.select("doc_id", "row_no", "raw", "open", "at", F.explode("pairs").alias("p")).where("p.field is not null")
    line = F.col("p.field").isin(*LINE_FIELDS)
    f = f.where(~line | F.col("open")).withColumn("item", F.when(line, F.col("at")).otherwise(0))
    return f.select("doc_id", "item", "row_no", F.col("p.field").alias("field"), value_for(F.col("p.field"), F.col("p.text")).alias("value"), "raw")


def source_tiers(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Price tiers ``doc_id, item, row_no, minimum, maximum, unit_price, raw`` that rows of text state while an item is open; ``found`` are the
    ``source_facts`` of the rows.

    They are of the item in force, or of the one that the row names as ``for <part number>:``, if just one of the items up to there has that
    number and no other. ``maximum`` is null for open tiers; ends that are no numbers leave a tier out."""
    text = itemised_rows(rows).where("kind = 'text' AND open")
    stated = text.select("doc_id", "row_no", "raw", "at", F.lower(clean_sku(F.nullif(F.regexp_extract("raw", NAMED_ITEM, 1), F.lit("")))).alias("named"), F.explode(price_tiers(F.col("raw"))).alias("tier"))
    stated = stated.where("tier.minimum is not null AND tier.unit_price is not null")
    skus = unique_facts(found.where("field = 'supplier_sku' AND item > 0")).where("unique").select("doc_id", F.lower("value").alias("named"), F.col("item").alias("holder"))
    named = stated.where("named is not null").select("doc_id", "row_no", "named", "at").distinct().join(skus, ["doc_id", "named"]).where("holder <= at")
    only = named.groupBy("doc_id", "row_no").agg(F.min("holder").alias("holder"), F.count("*").alias("holders")).where("holders = 1")
    out = stated.join(only, ["doc_id", "row_no"], "left")
    return out.select("doc_id", F.coalesce("holder", "at").alias("item"), "row_no", "tier.minimum", "tier.maximum", "tier.unit_price", "raw")


def tier_review(tiers: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, item, code`` of items with tiers: TIER_PRICE_REVIEW where not exactly one tier holds the item's quantity at the item's price. Tiers
    meet the quantity by their range; overlapping ones that both hold it are a case for review."""
    one = unique_facts(found.where("item > 0 AND field IN ('quantity', 'unit_price')")).where("unique")
    item = one.groupBy("doc_id", "item").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).try_cast("decimal(28,6)").alias(f) for f in ("quantity", "unit_price")))
    ranged = tiers.select("doc_id", "item", "minimum", "maximum", F.col("unit_price").alias("tier_price")).join(item, ["doc_id", "item"]).where("quantity is not null")
    holds = (F.col("minimum") <= F.col("quantity")) & (F.col("maximum").isNull() | (F.col("quantity") <= F.col("maximum")))
    counted = ranged.groupBy("doc_id", "item").agg(F.count_if(holds).alias("n"), F.count_if(holds & F.col("tier_price").eqNullSafe(F.col("unit_price"))).alias("fits"))
    return counted.where("n <> 1 OR fits <> 1").select("doc_id", "item", F.lit("TIER_PRICE_REVIEW").alias("code"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """Rows of image pages with recognition errors repaired."""
    return rows.withColumn("raw", F.when(F.col("image"), ocr_repair(F.col("raw"))).otherwise(F.col("raw")))


def unique_facts(facts: DataFrame) -> DataFrame:
    """``doc_id, item, field, value, unique``: unique if all facts of the field have one value and none is blank."""
    return facts.groupBy("doc_id", "item", "field").agg(
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("row_no"))).alias("value"), ((F.count_distinct("value") == 1) & (F.count("value") == F.count("*"))).alias("unique"), F.count("*").alias("facts")
    )


def recovered_by_arithmetic(facts: DataFrame) -> DataFrame:
    """For items of image pages (unique facts, wide): a price that total / quantity gives within 2 cents where the printed one does not, and
    a whole quantity that total / price gives. ``facts(doc_id, item, quantity, unit_price, stated_line_total)`` as decimals."""
    q, p, t = (F.col(c).cast("decimal(18,6)") for c in ("quantity", "unit_price", "stated_line_total"))
    price = F.round(F.try_divide(t, q), 6).cast("decimal(18,6)")
    off = p.isNull() | (F.abs(q * p - t) > F.lit("0.02").cast("decimal(18,2)"))
    fits = F.abs(q * price - t) <= F.lit("0.02").cast("decimal(18,2)")
    count = F.try_divide(t, p)
    whole = (count == F.floor(count)) & (count > 0)
    return facts.withColumn("unit_price", F.when((q != 0) & off & fits, price).otherwise(p)).withColumn("quantity", F.when(q.isNull() & whole, count.cast("decimal(18,6)")).otherwise(q))


def fits_storage(field: Column, value: Column) -> Column:
    """Whether a value can be stored: 6 decimals of prices, 4 of other numbers, lead times of 0 to 3650 days."""
    places = F.length(F.regexp_extract(value, r"\.(\d*)$", 1))
    return F.when(field.isin(*NUMBERS), value.try_cast("decimal(38,10)").isNotNull() & (places <= F.when(field == "unit_price", 6).otherwise(4))).when(field == "lead_time_days", value.try_cast("int").between(0, 3650)).otherwise(F.trim(value) != "")


def gate(model: DataFrame, facts: DataFrame) -> DataFrame:
    """Decide each field of ``model(doc_id, item, field, value)`` and of the facts: ``decision, accepted, model_value``, and whether the source
    overrode the model. A model's value is never evidence: ACCEPTED is the source's value if it is unique and can be stored, REVIEW_REQUIRED
    if the source has some other, REJECTED if only the model has one, else NOT_FOUND."""
    f = unique_facts(facts).withColumnRenamed("value", "source_value")
    m = model.select("doc_id", "item", "field", F.col("value").alias("model_value"))
    both = m.join(f, ["doc_id", "item", "field"], "full_outer")
    ok = F.coalesce(F.col("unique") & fits_storage(F.col("field"), F.col("source_value")), F.lit(False))
    decision = F.when(ok, "ACCEPTED").when(F.col("source_value").isNotNull(), "REVIEW_REQUIRED").when(F.col("model_value").isNotNull(), "REJECTED").otherwise("NOT_FOUND")
    out = both.withColumn("decision", decision).withColumn("accepted", F.when(ok, F.col("source_value")))
    number = lambda c: F.col(c).try_cast("decimal(38,10)")
    same = F.when(number("model_value").isNotNull() & number("source_value").isNotNull(), number("model_value") == number("source_value")).otherwise(F.lower(F.trim("model_value")) == F.lower(F.trim("source_value")))
    change = F.when(ok & F.col("model_value").isNull(), "explicit_source").when(ok & ~same, "deterministic_source_override").when(~ok & F.col("model_value").isNotNull(), F.col("decision"))
    codes = F.array_compact(F.array(
        F.when(~ok & F.col("model_value").isNotNull(), "UNSUPPORTED_EXTRACTED_VALUE"),
        F.when(~ok & (F.col("facts") > 0), "SOURCE_VALUE_CONFLICT"),
        F.when(~ok & (F.col("field") == "currency"), "CURRENCY_REVIEW_REQUIRED"),
        F.when(~ok & F.col("field").isin(*DATES) & (F.col("facts") > 0), "DATE_REVIEW_REQUIRED"),
    ))
    return out.select("doc_id", "item", "field", "model_value", "source_value", "decision", "accepted", change.alias("change"), codes.alias("codes"))


def gate_codes(model: DataFrame, found: DataFrame, rows: DataFrame, order: DataFrame) -> DataFrame:
    """Review codes ``doc_id, item, code`` of the gate beside those of its fields, for ``model(doc_id, item, field, value)``, the facts and ``rows`` of the source, and
    the ``order`` that ``in_source_order`` gives.

    QUANTITY_MOQ_AMBIGUITY: an item's stated quantity is only a minimum order in the source. TOTAL_COST_INCOMPLETE: no accepted shipping cost or tax.
    DOCUMENT_INSTRUCTION_TEXT_DETECTED: rows that read like instructions. SOURCE_ROWS_RECOVERED: rows that no extracted line was left for."""
    code = lambda df, name, item=0: df.select("doc_id", (F.lit(item) if item == 0 else F.col(item)).cast("int").alias("item"), F.lit(name).alias("code"))
    number = lambda c: F.col(c).try_cast("decimal(28,6)")
    said = model.where("item > 0 AND field = 'quantity'").select("doc_id", "item", number("value").alias("said")).where("said is not null")
    known = unique_facts(found.where("field = 'quantity'")).where("unique").select("doc_id", "item")
    least = found.where("field = 'moq'").select("doc_id", "item", number("value").alias("said")).distinct()
    unclear = said.join(known, ["doc_id", "item"], "left_anti").join(least, ["doc_id", "item", "said"], "left_semi")
    accepted = gate(model, found).where("item = 0 AND accepted is not null AND field IN ('shipping_cost', 'tax')").groupBy("doc_id").agg(F.count_distinct("field").alias("n"))
    docs = rows.select("doc_id").distinct()
    partly = docs.join(accepted, "doc_id", "left").where(F.coalesce("n", F.lit(0)) < 2)
    instructed = rows.where(F.col("raw").rlike(INSTRUCTION)).select("doc_id").distinct()
    recovered = order.where("line_no is null AND row_no is not null").select("doc_id").distinct()
    out = code(unclear, "QUANTITY_MOQ_AMBIGUITY", "item").unionByName(code(partly, "TOTAL_COST_INCOMPLETE"))
    return out.unionByName(code(instructed, "DOCUMENT_INSTRUCTION_TEXT_DETECTED")).unionByName(code(recovered, "SOURCE_ROWS_RECOVERED"))


def verification_requests(model: DataFrame, facts: DataFrame, instructed: DataFrame, n: int = 2) -> DataFrame:
    """Up to n prices and quantities of a document where source and model differ, to be checked again; none of documents with instruction text."""
    d = gate(model, facts).where("change = 'deterministic_source_override' AND field IN ('unit_price', 'quantity')").join(instructed.select("doc_id"), "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy("item", F.col("field").desc())
    return d.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def _ordered(lines: list[tuple]) -> list[tuple]:
    """Lines ``(number, part number, ...)`` by number, then part number; lines without a number last, without a part number first of theirs."""
    return sorted(lines, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or ""))


def greedy_pairs(wanted: list, given: list) -> list[tuple[int | None, int | None, bool]]:
    """Align lines ``(line_no, sku)`` in order: the first unused line of the same part number, else of the same place, else the first unused;
    unused ones stay extra."""
    left, rows = _ordered(given), []
    for i, (no, sku) in enumerate(_ordered(wanted)):
        hit = next((g for g in left if sku is not None and g[1] == sku), None)
        by_sku = hit is not None
        if hit is None:
            hit = next((g for g in left if g[0] == i), left[0] if left else None)
        rows.append((no, hit[0] if hit else None, by_sku))
        if hit:
            left.remove(hit)
    return rows + [(None, no, False) for no, _ in left]


def align_lines(wanted: DataFrame, given: DataFrame) -> DataFrame:
    """``doc_id, wanted_no, given_no, by_sku`` for lines ``(doc_id, line_no, sku)`` of both sides, document by document (lines number from 0)."""

    @F.pandas_udf("array<struct<wanted_no:int,given_no:int,by_sku:boolean>>")
    def pairs(w: pd.Series, g: pd.Series) -> pd.Series:
        lines = lambda x: [] if x is None else [(r["line_no"], r["sku"]) for r in x]
        return pd.Series([[{"wanted_no": a, "given_no": b, "by_sku": c} for a, b, c in greedy_pairs(lines(x), lines(y))] for x, y in zip(w, g, strict=True)], dtype=object)

    side = lambda df, n: df.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "sku")).alias(n))
    both = side(wanted, "w").join(side(given, "g"), "doc_id", "full_outer")
    return both.select("doc_id", F.explode(pairs("w", "g")).alias("p")).select("doc_id", "p.*")


def source_order(rows: list, lines: list) -> list[tuple[int | None, int | None]]:
    """Pair source rows ``(row_no, sku, viable)`` in order with extracted lines ``(line_no, sku)``: the first line left of the same part number,
    else the first one left. Rows without a line stay if they are viable; lines without a row come last."""
    left, out = _ordered(lines), []
    for no, sku, viable in _ordered(rows):
        hit = next((x for x in left if sku is not None and x[1] == sku), left[0] if left else None)
        if hit is not None:
            left.remove(hit)
            out.append((no, hit[0]))
        elif viable:
            out.append((no, None))
    return out + [(None, no) for no, _ in left]


def in_source_order(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """``doc_id, position, row_no, line_no``: extracted ``lines(doc_id, line_no, sku)`` in the order of their source ``rows(doc_id, row_no, sku,
    viable)``, document by document. A viable row that no line is left for is recovered: its line_no is null."""

    @F.pandas_udf("array<struct<row_no:int,line_no:int>>")
    def pairs(r: pd.Series, ls: pd.Series) -> pd.Series:
        listed = lambda x, *names: [] if x is None else [tuple(v[n] for n in names) for v in x]
        return pd.Series([[{"row_no": a, "line_no": b} for a, b in source_order(listed(x, "row_no", "sku", "viable"), listed(y, "line_no", "sku"))] for x, y in zip(r, ls, strict=True)], dtype=object)

    own = rows.groupBy("doc_id").agg(F.collect_list(F.struct("row_no", "sku", "viable")).alias("r"))
    both = own.join(lines.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "sku")).alias("l")), "doc_id", "full_outer")
    return both.select("doc_id", F.posexplode(pairs("r", "l")).alias("position", "p")).select("doc_id", "position", "p.*")


def align_lines_sql(wanted: DataFrame, given: DataFrame) -> DataFrame:
    """The native variant: the nth line of a part number meets the nth one, then what is left meets in order. Equal to the greedy one where part
    numbers are known and at most one line of a side is left."""
    nth = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "sku").orderBy("line_no")))
    w, g = nth(wanted).withColumnRenamed("line_no", "wanted_no"), nth(given).withColumnRenamed("line_no", "given_no")
    hit = w.where("sku is not null").join(g, ["doc_id", "sku", "n"]).select("doc_id", "wanted_no", "given_no", F.lit(True).alias("by_sku"))
    rest = lambda df, c: df.join(hit, ["doc_id", c], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(c))).select("doc_id", "k", c)
    left = rest(w, "wanted_no").join(rest(g, "given_no"), ["doc_id", "k"], "full_outer").select("doc_id", "wanted_no", "given_no", F.lit(False).alias("by_sku"))
    return hit.unionByName(left)


def structure_quality(rows: DataFrame) -> DataFrame:
    """Of ``rows(doc_id, row_no, cells array<string>, is_header)`` how table-like a document is: shares of signals, score and STRONG, WEAK or NONE."""
    filled = F.size(F.filter("cells", lambda c: F.trim(c) != ""))
    r = rows.withColumn("n", filled)
    by_n = r.where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("c"))
    consistent = by_n.groupBy("doc_id").agg(F.max("c").alias("modal"), F.sum("c").alias("filled"))
    per = r.groupBy("doc_id").agg(F.count_if((F.col("n") > 1) & ~F.col("is_header")).alias("data_rows"), F.count_if("is_header").alias("headers"), F.max("n").alias("columns"))
    s = per.join(consistent, "doc_id", "left")
    score = 30 * F.least(F.col("headers"), F.lit(1)) + 25 * F.least(F.col("data_rows"), F.lit(4)) / 4 + 20 * F.least(F.col("columns"), F.lit(4)) / 4 + 25 * F.coalesce(F.try_divide(F.col("modal"), F.col("filled")), F.lit(0.0))
    s = s.withColumn("score", F.floor(score).cast("int"))
    return s.withColumn("quality", F.when((F.col("score") >= 68) & (F.col("data_rows") >= 1), "STRONG").when(F.col("score") >= 25, "WEAK").otherwise("NONE"))


def choose_structure(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Per document the primary parser's structure if it is STRONG, else the fallback's, else whichever there is."""
    p, f = primary.select("doc_id", F.col("quality").alias("p")), fallback.select("doc_id", F.col("quality").alias("f"))
    chosen = F.when((F.col("p") == "STRONG") | F.col("f").isNull(), "primary").otherwise("fallback")
    return p.join(f, "doc_id", "full_outer").select("doc_id", chosen.alias("parser"))


def select_pages(pages: DataFrame, limit: int = 8) -> DataFrame:
    """Mark the first page and the ``limit - 1`` others with the most commercial words (ties: earlier pages) as selected."""
    p = pages.withColumn("score", F.regexp_count("text", F.lit(KEYWORDS)))
    w = Window.partitionBy("doc_id").orderBy((F.col("page") == 1).desc(), F.col("score").desc(), "page")
    return p.withColumn("selected", F.row_number().over(w) <= limit)
