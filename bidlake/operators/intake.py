"""Intake of messages and documents: roles, links, threads, offers, revisions and status of all messages as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.functions.numbers import lead_days, parse_number
from bidlake.functions.text import GENERIC_DOMAINS, classify_email, email_domain, identity_name, norm_email, norm_message_id, norm_subject, norm_supplier, rfq_token
from bidlake.operators import changes, mail, matching
from bidlake.sources.sinks import put_epoch, table_exists

ORG = "organization_id"
# Kinds of messages that may hold an offer, head cells and the field that each names.
OFFER_KINDS = ("QUOTE", "QUOTE_REVISION", "RFQ_RESPONSE", "NEGOTIATION")
HEAD_CELLS = {
    "sku": "supplier_sku", "part number": "supplier_sku", "part": "supplier_sku", "description": "description", "item": "description", "qty": "quantity", "quantity": "quantity", "uom": "uom", "unit": "uom",
    "unit price": "unit_price", "price": "unit_price", "moq": "moq", "lead time": "lead_time_days", "line total": "stated_line_total", "total": "stated_line_total",
}
NUMBERS = ("quantity", "unit_price", "moq", "stated_line_total")


def pasted_emails(columns: DataFrame) -> DataFrame:
    """Messages that come as columns ``(raw, sender, subject, sent_at, message_id, in_reply_to, refs, body, ...)``, with the same fields as decoded
    ones. ``is_message`` marks raw text that starts with mail heads: that is for the decoder; other raw text is the body."""
    heads = F.coalesce(F.split_part("raw", F.lit("\n\n"), F.lit(1)).rlike(r"(?im)^(From|To|Subject|Date|Message-ID):"), F.lit(False))
    address = F.coalesce(F.nullif(F.regexp_extract("sender", r"<([^<>]+)>", 1), F.lit("")), F.col("sender"))
    address = F.when(F.contains(address, F.lit("@")), norm_email(address)).otherwise("")
    name = F.when(F.contains("sender", F.lit("<")), F.btrim(F.split_part("sender", F.lit("<"), F.lit(1)), F.lit(' "'))).otherwise("")
    refs = F.filter(F.transform(F.coalesce("refs", F.array().cast("array<string>")), norm_message_id), lambda x: x.isNotNull())
    return columns.withColumns({
        "is_message": heads, "sender_name": F.when(address != "", name).otherwise(""), "sender_email": address, "sender_domain": email_domain(address), "subject": F.substring(F.coalesce("subject", F.lit("")), 1, 998),
        "normalized_subject": norm_subject(F.col("subject")), "message_id": norm_message_id(F.col("message_id")), "in_reply_to": norm_message_id(F.col("in_reply_to")), "refs": refs,
        "body": F.coalesce(F.when(~heads, F.col("raw")), "body", F.lit("")),
    })


def known_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``document_id`` to ``files(organization_id, sha256, ...)``: that of the stored document (the least id) with the same bytes, which
    then need not be read again, else null."""
    first = stored.groupBy(ORG, "sha256").agg(F.min("document_id").alias("document_id"))
    return files.join(first, [ORG, "sha256"], "left")


def with_counts(parents: DataFrame, children: DataFrame, key: list[str], name: str) -> DataFrame:
    """Add the number of children of each parent, 0 if none."""
    return parents.join(children.groupBy(*key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def page_totals(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    """``by, total, pages``: rows of each group and pages of ``size`` that show them."""
    return rows.groupBy(*by).agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def heads(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of all in this order: each task keeps n, nothing is sorted as a whole."""
    return rows.orderBy(*order).limit(n)


def bounded_rows(rows: DataFrame, limit: int = 250) -> DataFrame:
    """Add ``shown`` to ``rows(doc_id, row_no, source_type, mapped, is_header)``: whether a row is among the first ``limit`` of its document that
    a model is shown. Rows of page layouts without a mapped field that are no headers are not; all rows stay as evidence."""
    useful = ~F.col("source_type").isin("ocr_layout", "pdf_words") | F.col("mapped") | F.col("is_header")
    w = Window.partitionBy("doc_id", "useful").orderBy("row_no")
    return rows.withColumn("useful", F.coalesce(useful, F.lit(False))).withColumn("shown", F.col("useful") & (F.row_number().over(w) <= limit)).drop("useful")


def table_items(rows: DataFrame) -> DataFrame:
    """Items ``email_id, line_no, field, value`` of tables ``(email_id, table_no, row_no, cells)``: a row of which two cells or more name fields,
    the part number or description among them, heads the rows below it."""
    names = F.create_map(*(F.lit(x) for pair in HEAD_CELLS.items() for x in pair))
    fields = F.transform("cells", lambda c: F.try_element_at(names, F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))))
    r = rows.withColumn("fields", fields)
    named = F.filter("fields", lambda f: f.isNotNull())
    is_head = (F.size(named) >= 2) & (F.array_contains(named, "supplier_sku") | F.array_contains(named, "description"))
    over = Window.partitionBy("email_id", "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("is_head", F.coalesce(is_head, F.lit(False))).withColumn("head", F.last(F.when(F.col("is_head"), F.col("fields")), True).over(over))
    r = r.where(~F.col("is_head") & F.col("head").isNotNull())
    cells = r.select("email_id", "table_no", "row_no", F.explode(F.arrays_zip(F.col("head").alias("field"), F.col("cells").alias("raw"))).alias("c"))
    raw = F.trim("c.raw")
    value = F.when(F.col("c.field").isin(*NUMBERS), parse_number(raw, "plain").cast("string")).when(F.col("c.field") == "lead_time_days", lead_days(raw, "email").cast("string")).otherwise(raw)
    long = cells.select("email_id", "table_no", "row_no", F.col("c.field").alias("field"), value.alias("value")).where("field is not null AND value <> ''")
    offers = F.max(F.col("field").isin("supplier_sku", "description", "quantity", "unit_price")).over(Window.partitionBy("email_id", "table_no", "row_no"))
    long = long.withColumn("offers", offers).where("offers")
    line = F.dense_rank().over(Window.partitionBy("email_id").orderBy("table_no", "row_no")) - 1
    return long.select("email_id", line.alias("line_no"), "field", "value")


def candidate_union(heads: DataFrame, tables: DataFrame, rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidates of messages: the heads' facts, and as items those of tables and structured rows, both, else those of text lines. Items are
    numbered anew, tables first, and equal ones (part number, quantity, price) count once. All ``(email_id, line_no, field, value)``."""
    structured = tables.withColumn("part", F.lit(0)).unionByName(rows.withColumn("part", F.lit(1)))
    text = lines.where("line_no is not null").withColumn("part", F.lit(2)).join(structured.select("email_id").distinct(), "email_id", "left_anti")
    items = structured.unionByName(text)
    pick = lambda f: F.coalesce(F.lower(F.max(F.when(F.col("field") == f, F.col("value")))), F.lit("")).alias(f)
    keys = items.groupBy("email_id", "part", "line_no").agg(*(pick(f) for f in ("supplier_sku", "quantity", "unit_price")))
    first = keys.groupBy("email_id", "supplier_sku", "quantity", "unit_price").agg(F.min(F.struct("part", "line_no")).alias("at")).select("email_id", "at.part", "at.line_no")
    number = (F.row_number().over(Window.partitionBy("email_id").orderBy("part", "line_no")) - 1).cast("int")
    kept = items.join(first.withColumn("number", number), ["email_id", "part", "line_no"]).select("email_id", F.col("number").alias("line_no"), "field", "value")
    return heads.where("line_no is null").select("email_id", F.col("line_no").cast("int").alias("line_no"), "field", "value").unionByName(kept)


def alias_union(suppliers: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Suppliers with the quoted names ``confirmed(organization_id, supplier_id, quoted_name)`` among their aliases, sorted, each once; a supplier's
    own name is no alias."""
    names = confirmed.join(suppliers.select(ORG, "supplier_id", "name"), [ORG, "supplier_id"]).where("quoted_name <> name AND quoted_name <> ''")
    new = names.groupBy(ORG, "supplier_id").agg(F.collect_set("quoted_name").alias("more"))
    both = F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>"))))
    return suppliers.join(new, [ORG, "supplier_id"], "left").withColumn("aliases", both).drop("more")


def threads(messages: DataFrame, days: int = 30) -> DataFrame:
    """Add ``thread`` to ``messages(organization_id, email_id, message_id, refs, normalized_subject, supplier_id, rfq_id, sent_at)``: messages that
    references connect are one thread; those without any reference to another join by subject, supplier and request while no more than
    ``days`` lie between them."""
    tied = changes.thread_roots(messages.where("message_id is not null").select(ORG, "message_id", "refs"))
    size = tied.groupBy(ORG, "root").agg(F.count("*").alias("n")).where("n > 1")
    tied = tied.join(size, [ORG, "root"]).select(ORG, "message_id", F.concat(F.lit("r|"), "root").alias("by_reference"))
    m = mail.join_threads(messages, days).withColumnRenamed("thread", "by_subject").drop("session", "subject_key")
    m = m.join(tied, [ORG, "message_id"], "left")
    linked = F.col("supplier_id").isNotNull() | F.col("rfq_id").isNotNull()
    alone = F.concat_ws("|", F.lit("m"), ORG, F.col("email_id").cast("string"))
    return m.withColumn("thread", F.coalesce("by_reference", F.when(linked, F.col("by_subject")), alone)).drop("by_reference", "by_subject")


def email_intake(
    emails: DataFrame, users: DataFrame, suppliers: DataFrame, contacts: DataFrame, rfqs: DataFrame, attachments: DataFrame | None = None, tables: DataFrame | None = None, attachment_texts: DataFrame | None = None, staged: Callable[[DataFrame, str], DataFrame] = changes.written
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(messages, offers, conflicts)`` of ``emails(organization_id, email_id, message_id, refs, sender_name, sender_email, subject, body, sent_at, rfq_id)``.

    Messages get the role of their sender, the kind, the supplier (contact, domain, alias, name, else similar ones for review, else a new one),
    the request, the thread, and a status with all reasons. Suppliers' messages of a kind that may offer, with evidence of an offer, become
    revisions ``quote_no`` of their thread, the last of which is effective. ``attachments`` holds candidates ``(email_id, ordinal, line_no, field,
    value)``, ``tables`` the messages' tables, ``attachment_texts(email_id, ordinal, text)`` texts that may name the request. A supplier whom neither sender
    nor signature names is named by the first attachment that does. ``staged`` writes what several branches read.
    """
    spark = emails.sparkSession
    parts = mail.message_parts(emails).withColumnRenamed("body", "whole").withColumn("body", F.col("normalized_body"))
    named = matching.sender_role(parts, users).withColumns({
        "email_type": classify_email(F.col("subject"), F.col("body")), "sender_domain": email_domain(F.col("sender_email")), "normalized_subject": norm_subject(F.col("subject")),
    })
    identity = F.nullif(identity_name(F.col("sender_name"), F.col("signature"), F.col("sender_domain")), F.lit(""))
    if attachments is not None:
        stated = attachments.where("field = 'supplier_name' AND value <> ''")
        named = named.join(stated.groupBy("email_id").agg(F.min_by("value", F.struct("ordinal", "line_no", "value")).alias("stated_name")), "email_id", "left")
        identity = F.coalesce(identity, F.col("stated_name"))
    if attachment_texts is not None:
        numbers = attachment_texts.select("email_id", rfq_token(F.col("text")).alias("number")).where("number is not null").groupBy("email_id").agg(F.collect_set("number").alias("numbers"))
        named = named.join(numbers, "email_id", "left")
    else:
        named = named.withColumn("numbers", F.lit(None).cast("array<string>"))
    # texts that later steps do not read are not written
    named = staged(named.withColumn("identity", identity).drop("whole", "normalized_body", "quoted_history", "signature", "stated_name"), "named")
    selling = named.where("sender_role = 'SUPPLIER'")
    found = matching.match_senders(selling.select(ORG, "email_id", F.col("sender_email").alias("email"), F.col("identity").alias("name")), suppliers, contacts, "email_id")
    found = staged(found.select(ORG, F.col("left_id").alias("email_id"), F.col("right_id").alias("supplier_id"), "method"), "senders")
    unknown = selling.join(found.where("supplier_id is null").select(ORG, "email_id"), [ORG, "email_id"]).where("identity is not null")
    similar = matching.possible_suppliers(unknown.select(ORG, F.col("identity").alias("left_id"), F.col("identity").alias("text")).distinct(), suppliers)
    similar = similar.select(ORG, F.col("left_id").alias("identity")).distinct().withColumn("similar", F.lit(True))
    public = F.col("sender_domain").isin(*GENERIC_DOMAINS) & (norm_supplier(F.col("identity")) == norm_supplier(F.col("sender_name"))) & ~F.col("identity").rlike(r"(?i)\b(supply|industrial|company|corp|inc|llc|ltd|components|automation)\b")
    m = named.join(found, [ORG, "email_id"], "left").join(similar, [ORG, "identity"], "left")
    method = F.when(F.col("sender_role") != "SUPPLIER", "SENDER_NOT_SUPPLIER").when(F.col("supplier_id").isNotNull(), F.col("method")).when(F.col("similar"), "POSSIBLE_EXISTING_SUPPLIER")
    method = method.when(F.col("identity").isNull() | public, "SUPPLIER_IDENTITY_REVIEW_REQUIRED").otherwise("NEW_UNVERIFIED_CREATED")
    m = m.withColumn("supplier_method", method).drop("method", "similar")
    m = m.withColumn("supplier_key", F.coalesce(F.col("supplier_id").cast("string"), F.when(F.col("supplier_method") == "NEW_UNVERIFIED_CREATED", F.concat(F.lit("new|"), norm_supplier(F.col("identity"))))))
    r = matching.match_rfqs(m.select(ORG, "email_id", "rfq_id", "subject", "body", "numbers"), rfqs.withColumnRenamed("rfq_id", "request_id"), "email_id", "subject", "body", more="numbers")
    rfq_method = F.when(F.col("method") == "EXPLICIT", "EXPLICIT_RFQ").when(F.col("method") == "NUMBER", "EXACT_RFQ_NUMBER").when(F.col("method").startswith("AMBIGUOUS"), "AMBIGUOUS_RFQ").otherwise("UNMATCHED_RFQ")
    m = m.drop("rfq_id").join(r.select(ORG, F.col("left_id").alias("email_id"), F.col("right_id").alias("rfq_id"), rfq_method.alias("rfq_method")), [ORG, "email_id"], "left")
    m = staged(threads(m.withColumn("supplier_link", F.col("supplier_id")).withColumn("supplier_id", F.col("supplier_key")), 30).withColumn("supplier_id", F.col("supplier_link")).drop("supplier_link"), "linked")
    none = spark.createDataFrame([], "email_id string, line_no int, field string, value string")
    own = mail.email_candidates(m)
    body = own if tables is None else candidate_union(own, table_items(tables), none, own)
    body = staged(body.select("email_id", "line_no", "field", "value"), "candidates")
    merged, conflicts = mail.reconcile(body, none.withColumn("ordinal", F.lit(1)) if attachments is None else attachments, m.select("email_id", "body"))
    conflicts = staged(conflicts, "conflicts")
    # an offer needs any of the supplier's, quote's or request's name, the currency, or an item
    offered = merged.where(F.col("key").isNotNull() | F.col("field").isin("supplier_name", "quote_number", "rfq_number", "currency")).select("email_id").distinct()
    offered = staged(offered, "offered").withColumn("offered", F.lit(True))
    review = conflicts.where("resolution = 'REVIEW_REQUIRED'").select("email_id").distinct().withColumn("conflicting", F.lit(True))
    m = m.join(offered, "email_id", "left").join(review, "email_id", "left")
    supported = F.col("email_type").isin(*OFFER_KINDS)
    reasons = F.array_compact(F.array(
        F.when(F.col("sender_email").isNull() | (F.col("sender_email") == ""), "Missing From header"), F.when(F.col("supplier_key").isNull(), F.col("supplier_method")), F.when(F.col("rfq_id").isNull(), F.col("rfq_method")),
        F.when(~supported, "Email is not a supported quote workflow type"), F.when(F.col("offered").isNull(), "No evidence-backed supplier quote fields found"),
    ))
    reasons = F.when((F.size(reasons) == 0) & F.col("conflicting"), F.array(F.lit("Field conflict requires review."))).otherwise(F.array_distinct(reasons))
    m = m.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "COMPLETE").otherwise("NEEDS_REVIEW"))
    messages = m.select(ORG, "email_id", "sender_role", "email_type", "supplier_id", "supplier_method", "rfq_id", "rfq_method", "thread", "sent_at", "status", F.array_join("reasons", "; ").alias("status_reason"), (F.col("offered").isNotNull() & supported & (F.col("sender_role") == "SUPPLIER")).alias("offers"))
    quotes = changes.revisions(messages.where("offers"), [ORG, "thread"], ["sent_at", "email_id"], "email_id")
    offers = quotes.select(ORG, "email_id", "thread", "supplier_id", "rfq_id", F.col("revision_number").alias("quote_no"), "supersedes", "effective", (F.col("status") != "COMPLETE").alias("needs_review"))
    return messages, offers, conflicts


#: The tables of an intake and their keys.
STORED = {"messages": ("email_id",), "offers": ("email_id",), "conflicts": ("email_id", "field")}


def stored(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame | None:
    """The latest row of each key of a stored table, with the ``epoch`` that wrote it; of the runs before ``before`` only. None if there is none."""
    if not table_exists(spark, f"{folder}/{name}"):
        return None
    rows = spark.read.parquet(f"{folder}/{name}")
    rows = rows if before is None else rows.where(F.col("epoch") < before)
    last = rows.groupBy(*STORED[name]).agg(F.max("epoch").alias("epoch"))
    return rows.join(last, [*STORED[name], "epoch"], "left_semi")


def store_intake(messages: DataFrame, offers: DataFrame, conflicts: DataFrame, folder: str, epoch: int) -> None:
    """Upsert the results of one run by key. Messages that an earlier run left COMPLETE stay as they are, and rows that are stored alike are not
    written again, so a run over what is known changes nothing; a run of the same ``epoch`` replaces what it wrote before."""
    spark = messages.sparkSession
    for name, rows in (("messages", messages), ("offers", offers), ("conflicts", conflicts)):
        known = stored(spark, folder, name, epoch)
        if known is not None:
            known = known.select(*rows.columns)
            if name == "messages":
                rows = rows.join(known.where("status = 'COMPLETE'").select("email_id"), "email_id", "left_anti").select(*rows.columns)
            rows = rows.subtract(known)
        put_epoch(rows, epoch, f"{folder}/{name}")


def persist_extractions(quotes: DataFrame, lines: DataFrame, suppliers: DataFrame, rfqs: DataFrame, items: DataFrame, aliases: DataFrame, mappings: DataFrame, increases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Link extracted offers to the catalog, all at once: ``(quotes, lines, findings)``.

    ``quotes(organization_id, doc_id, supplier_name, supplier_email, rfq_id, rfq_number, confidence)`` get supplier and request; ``lines(organization_id, doc_id,
    line_no, supplier_sku, manufacturer_part_number)`` the item and how it was found. Findings: SUPPLIER_UNMATCHED, SKU_UNMATCHED for each line, and
    HISTORICAL_PRICE_ANOMALY for documents of ``increases(organization_id, doc_id)`` whose request is known. Any of them caps the confidence at
    0.4 and asks for review; the document's stage says whether supplier and request are known.
    """
    s = matching.match_suppliers(quotes.select(ORG, "doc_id", F.col("supplier_name").alias("name"), F.col("supplier_email").alias("email")), suppliers, "doc_id")
    q = quotes.join(s.select(ORG, F.col("left_id").alias("doc_id"), F.col("right_id").alias("supplier_id")), [ORG, "doc_id"], "left")
    known = rfqs.select(ORG, F.col("rfq_id").alias("own_rfq"), F.col("number").alias("own_number"))
    by_id = known.select(ORG, F.col("own_rfq").alias("rfq_id"), F.col("own_rfq").alias("named_id"))
    by_number = known.groupBy(ORG, F.col("own_number").alias("rfq_number")).agg(F.min("own_rfq").alias("numbered_id"))
    q = q.join(by_id, [ORG, "rfq_id"], "left").join(by_number, [ORG, "rfq_number"], "left")
    q = q.withColumn("request_id", F.when(F.col("rfq_id").isNotNull(), F.col("named_id")).otherwise(F.col("numbered_id"))).drop("named_id", "numbered_id")
    line = lines.join(q.select(ORG, "doc_id", "supplier_id"), [ORG, "doc_id"]).withColumn("line_key", F.concat_ws("|", "doc_id", "line_no"))
    i = matching.match_items(line.select(ORG, "line_key", "supplier_id", F.col("supplier_sku").alias("sku"), F.col("manufacturer_part_number").alias("mpn")), items, aliases, mappings, "line_key")
    line = line.join(i.select(ORG, F.col("left_id").alias("line_key"), F.col("right_id").alias("item_id"), F.col("method").alias("match_method")), [ORG, "line_key"], "left").drop("line_key")
    finding = lambda df, code, at: df.select(ORG, "doc_id", at.cast("int").alias("line_no"), F.lit(code).alias("code"))
    none = F.lit(None)
    found = finding(q.where("supplier_id is null"), "SUPPLIER_UNMATCHED", none).unionByName(finding(line.where("item_id is null"), "SKU_UNMATCHED", F.col("line_no")))
    dear = q.where("request_id is not null").join(increases.select(ORG, "doc_id").distinct(), [ORG, "doc_id"], "left_semi")
    found = found.unionByName(finding(dear, "HISTORICAL_PRICE_ANOMALY", none))
    capped = found.select(ORG, "doc_id").distinct().withColumn("needs_review", F.lit(True))
    q = q.join(capped, [ORG, "doc_id"], "left")
    stage = F.when(F.col("supplier_id").isNull() | F.col("request_id").isNull(), "Review Required").otherwise("Complete")
    q = q.withColumns({
        "confidence": F.when(F.col("needs_review"), F.least("confidence", F.lit("0.4").cast("decimal(5,4)"))).otherwise(F.col("confidence")), "needs_review": F.coalesce("needs_review", F.lit(False)), "stage": stage,
        "error": F.when(F.col("request_id").isNull(), "RFQ not identified. Select the RFQ during review."),
    })
    return q, line, found
