"""Queries on the intake of messages and documents, and on what their texts support."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.functions import evidence as fe
from bidlake.functions import sql as fsql
from bidlake.functions import text as ft
from bidlake.operators import changes, evaluate, facts, intake, matching, revisions
from bidlake.plans import adapters as a
from bidlake.plans.documents import _named
from bidlake.plans.sql import BASE, with_
from bidlake.sources.sinks import shared_folder

ORG = "organization_id"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as messages: by suppliers known by contact or alias, by own users, and by firms not known yet; every seventh offers nothing."""
    b, k = _named(spark, sf_dir), F.col("item_id") + F.col("supplier_id")
    s = F.col("supplier_id")
    name = F.when(k % 4 == 1, F.concat(F.lit("S"), s, F.lit(" Ltd"))).when(k % 4 == 3, F.concat(F.lit("Zyx Qwv "), k % 40, F.lit(" GmbH"))).otherwise("Ann")
    sender = F.when(k % 4 == 0, F.concat(F.lit("bid"), s, F.lit("@c.example.org"))).when(k % 4 == 1, "me@gmail.com").when(k % 4 == 2, "me@own.example.net").otherwise(F.concat(F.lit("new"), k % 40, F.lit("@fresh.example.net")))
    offer = F.concat(F.when(k % 11 == 0, "Updated quote no. QN").otherwise("Quote no. QN"), k, F.lit("\nAX-"), F.col("item_id"), F.lit("\nQty: "), F.col("quantity").cast("int"), F.lit(", unit price: USD "), F.col("unit_price").cast("decimal(18,4)"))
    return b.select(
        ORG, F.col("purchase_id").alias("email_id"), F.concat(F.lit("<"), F.col("purchase_id"), F.lit("@x>")).alias("message_id"), F.array().cast("array<string>").alias("refs"), name.alias("sender_name"), sender.alias("sender_email"),
        F.when(k % 5 != 4, F.concat(F.lit("Re: RFQ-"), F.col("item_id") + 1000)).otherwise("hello").alias("subject"), F.when(k % 7 == 0, "See you Monday.").otherwise(offer).alias("body"), F.col("date").cast("timestamp").alias("sent_at"), F.lit(None).cast("long").alias("rfq_id"),
    )


def _intake(spark: SparkSession, sf_dir: str, messages: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    users = spark.createDataFrame([(a.TENANT, "me@own.example.net")], f"{ORG} string, email string")
    s = a.suppliers(spark, sf_dir)
    contacts = s.select(ORG, "supplier_id", F.concat(F.lit("bid"), "supplier_id", F.lit("@c.example.org")).alias("email"))
    mails = _messages(spark, sf_dir) if messages is None else messages
    return intake.email_intake(mails, users, s, contacts, a.rfqs(spark, sf_dir), attachment_texts=texts)


def email_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _intake(spark, sf_dir)[0]
    return m.select("email_id", "sender_role", "email_type", "supplier_id", "supplier_method", "rfq_id", "rfq_method", "status", "status_reason", "offers")


def stored_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages taken in over three runs: half of them without attachments, all with attachments, of which some name the request, and all once
    more. ``written_again`` counts what the last run wrote."""
    m, folder = _messages(spark, sf_dir), f"{shared_folder(spark)}/intake-{uuid.uuid4().hex}"
    item = F.regexp_extract("body", r"AX-(\d+)", 1)
    texts = m.where("subject = 'hello'").select("email_id", F.lit(1).alias("ordinal"), F.concat(F.lit("Your request RFQ-"), item.try_cast("long") + 1000).alias("text"))
    intake.store_intake(*_intake(spark, sf_dir, m.where(F.pmod(F.hash("email_id"), F.lit(2)) == 0)), folder, 0)
    whole = _intake(spark, sf_dir, m, texts)
    for epoch in (1, 2):
        intake.store_intake(*whole, folder, epoch)
    again = sum(t.where("epoch = 2").count() for name in intake.STORED if (t := intake.stored(spark, folder, name)) is not None)
    return intake.stored(spark, folder, "messages").select("email_id", "rfq_id", "rfq_method", "status", F.lit(again).alias("written_again"))


def intake_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intake(spark, sf_dir)[1].select("email_id", "supplier_id", "rfq_id", "quote_no", "supersedes", "effective", "needs_review")


def _extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    b, k = a.base(spark, sf_dir), F.col("po_number")
    name = F.when(k % 3 == 0, F.concat(F.lit("s "), k % 700, F.lit(" ltd."))).when(k % 3 == 1, F.concat(F.lit("Supplier#"), F.lpad((k % 70).cast("string"), 9, "0"))).otherwise("nobody")
    quotes = a.table(spark, sf_dir, "orders").select(
        F.lit(a.TENANT).alias(ORG), F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("po_number"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 300).alias("rfq_id"), F.concat(F.lit("RFQ-"), F.col("o_orderkey") % 2500 + 1000).alias("rfq_number"), F.lit("0.9").cast("decimal(5,4)").alias("confidence")
    )
    quotes = quotes.withColumns({"supplier_name": name, "supplier_email": F.lit(None).cast("string")}).drop("po_number")
    sku = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("?"), "item_id")).otherwise(F.concat(F.lit("p-"), "item_id"))
    one = b.groupBy(ORG, k.alias("doc_id"), "line_no").agg(F.min("item_id").alias("item_id"))
    lines = one.select(ORG, "doc_id", "line_no", sku.alias("supplier_sku"), F.lit(None).cast("string").alias("manufacturer_part_number"))
    items = a.items(spark, sf_dir)
    no_alias, no_map = items.select(ORG, "item_id", F.lit("none").alias("alias")).where("item_id < 0"), items.select(ORG, F.col("item_id").alias("supplier_id"), F.lit("none").alias("supplier_sku"), "item_id").where("item_id < 0")
    dear = quotes.where("doc_id % 5 = 0").select(ORG, "doc_id")
    return quotes, lines, a.suppliers(spark, sf_dir), a.rfqs(spark, sf_dir), items, no_alias, no_map, dear


def persisted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.persist_extractions(*_extracted(spark, sf_dir))[0].select("doc_id", "supplier_id", "request_id", F.col("confidence").cast("double").alias("confidence"), "needs_review", "stage")


def persisted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.persist_extractions(*_extracted(spark, sf_dir))[2].select("doc_id", "line_no", "code")


def pasted_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = a.table(spark, sf_dir, "customer"), F.col("c_custkey")
    e = c.select(
        k.alias("cust"), F.when(k % 3 == 0, F.concat(F.lit("From: a@b.org\nSubject: x\n\nbody "), k)).when(k % 3 == 1, F.concat(F.lit("just text "), k)).alias("raw"),
        F.when(k % 4 == 0, F.concat(F.lit('"Firm '), k, F.lit('" <Sales@Firm'), k, F.lit(".ORG>"))).when(k % 4 == 1, F.concat(F.lit(" Me"), k, F.lit("@X.org "))).when(k % 4 == 2, "no address").alias("sender"), F.concat(F.lit("RE: fwd:  Offer "), k).alias("subject"), F.lit(None).cast("timestamp").alias("sent_at"),
        F.concat(F.lit("x <id"), k, F.lit("@h> y")).alias("message_id"), F.when(k % 2 == 0, "").otherwise("<r@h>").alias("in_reply_to"), F.array(F.lit("<r@h>"), F.lit(" "), F.lit("plain")).alias("refs"), F.when(k % 2 == 0, "own body").alias("body"),
    )
    return intake.pasted_emails(e).select("cust", "is_message", "sender_name", "sender_email", "sender_domain", "normalized_subject", "message_id", "in_reply_to", F.size("refs").alias("n_refs"), "body")


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.table(spark, sf_dir, "documents").select(F.lit(a.TENANT).alias(ORG), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return intake.known_files(d, d.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "document_id")).select("doc_id", "document_id")


def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("po_number"))
    return intake.with_counts(o, a.base(spark, sf_dir).where("l_returnflag = 'R'"), ["po_number"], "files")


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.page_totals(a.base(spark, sf_dir), ["supplier_id"], 25)


def newest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return intake.heads(e, 12, F.col("ts").desc(), F.col("event_id"))


def bounded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no")
    rows = a.doc_lines(spark, sf_dir).select("doc_id", n.alias("row_no"), F.when(n % 3 == 0, "ocr_layout").otherwise("csv").alias("source_type"), (n % 2 == 0).alias("mapped"), (n == 3).alias("is_header"))
    return intake.bounded_rows(rows, 5).groupBy("doc_id").agg(F.count_if("shown").alias("shown"), F.count("*").alias("rows"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables in messages: a head above the lines, but for every fifth order."""
    b, k = a.base(spark, sf_dir), F.col("po_number")
    n = (F.row_number().over(Window.partitionBy("po_number").orderBy("line_no", "purchase_id", "quantity", "unit_price"))).alias("row_no")
    body = b.select(k.cast("string").alias("email_id"), F.lit(0).alias("table_no"), n, F.array(F.concat(F.lit("AX-"), "item_id"), F.format_number(F.col("quantity").cast("int") * 100, 0), F.concat(F.lit("$"), F.col("unit_price").cast("decimal(18,2)")), F.when(k % 3 == 0, "2-3 weeks").otherwise(" ")).alias("cells"))
    o = a.table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")
    head = o.select(F.col("o_orderkey").cast("string").alias("email_id"), F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.array(F.lit("SKU"), F.lit("Qty."), F.lit("Unit Price"), F.lit("Lead time")).alias("cells"))
    return body.unionByName(head)


def table_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.table_items(_tables(spark, sf_dir)).select("email_id", "line_no", "field", "value")


def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of tables, else of text; every order has two equal lines of text."""
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("email_id"), F.col("o_orderkey").alias("k"))
    field = lambda n, f, v: F.struct(F.lit(n).cast("int").alias("line_no"), F.lit(f).alias("field"), v.cast("string").alias("value"))
    k = F.col("k")
    text = o.select("email_id", F.explode(F.array(field(None, "currency", F.lit("USD")), field(0, "supplier_sku", k), field(0, "moq", F.lit(1)), field(1, "supplier_sku", k), field(2, "supplier_sku", k + 1))).alias("f")).select("email_id", "f.*")
    none = text.where("line_no < 0").select("email_id", "line_no", "field", "value")
    return intake.candidate_union(text, intake.table_items(_tables(spark, sf_dir)), none, text)


def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.base(spark, sf_dir).where("line_no = 1").select(ORG, "supplier_id", F.when(F.col("item_id") % 3 == 0, F.col("supplier_name")).otherwise(F.concat(F.lit("Name "), F.col("item_id") % 4)).alias("quoted_name"))
    out = intake.alias_union(a.suppliers(spark, sf_dir), b)
    return out.select("supplier_id", F.array_join("aliases", ";").alias("aliases"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars that no other query uses, each on a text made of a part's columns."""
    p, k = a.table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.col("p_name")
    mail_id = F.when(k % 3 == 0, F.concat(F.lit("a <"), k, F.lit("@h> <b@h>"))).when(k % 3 == 1, F.concat(F.lit("  id"), k, F.lit("\t x "))).otherwise(" ")
    signature = F.when(k % 4 == 0, F.concat(F.lit("Best\nAnn\n- "), name, F.lit("  Supply Co |"))).when(k % 4 == 1, "Ann\nann@supply.org\n+1 555 123 45 67").otherwise("")
    return p.select(
        k.alias("part"), ft.norm_message_id(mail_id).alias("message_id"), ft.safe_filename(F.concat(F.lit("c:\\tmp/"), name, F.lit("\\q.pdf"))).alias("filename"), ft.column_name(k).alias("column"), ft.content_hash(name, F.lit(None), k).alias("hash"),
        ft.row_label(F.when(k % 2 == 0, F.concat(F.lit('["Qty", "'), k, F.lit('"]'))).otherwise(F.concat(name, F.lit(" : 5, x")))).alias("label"), ft.decimal_suspect(F.concat(F.lit(" "), k % 2000)).alias("suspect"), ft.ocr_repair(F.concat(F.lit("AX - "), k, F.lit(" / 7, 12. 5"))).alias("repaired"),
        ft.identity_name(F.lit("Ann"), signature, F.when(k % 3 == 0, "gmail.com").when(k % 3 == 1, "bolt-works.com")).alias("identity"), fe.joined_name(F.concat(F.lit("J uniper "), k), k % 2 == 0).alias("joined"),
    )


def price_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = a.base(spark, sf_dir), F.col("item_id")
    price = F.col("unit_price").cast("decimal(18,2)")
    text = F.concat(F.lit("Tiers: 1 - "), F.format_number(k * 10, 0), F.lit(": USD "), price, F.when(k % 2 == 0, F.concat(F.lit("; "), k * 10 + 1, F.lit("+ = $"), price - 0.01)).otherwise(""))
    t = b.select(F.monotonically_increasing_id().alias("n"), F.explode(fe.price_tiers(text)).alias("t"))
    return t.groupBy("t.minimum", "t.maximum", "t.unit_price").agg(F.count("*").alias("n"))


def supported_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of lines against texts that hold them, hold others that look alike, or none."""
    b, k = a.base(spark, sf_dir), F.col("item_id")
    q, d = F.col("quantity").cast("int"), F.col("line_no")
    cases = F.array(
        F.struct(F.lit("quantity").alias("field"), q.cast("string").alias("value"), F.concat(F.lit("qty "), F.format_number(q * F.when(k % 2 == 0, 1).otherwise(1000), 0)).alias("text")),
        F.struct(F.lit("unit_price").alias("field"), F.lit("12.50").alias("value"), F.when(k % 3 == 0, "at 12,5 each").when(k % 3 == 1, "x12.5").otherwise("12.5-3").alias("text")),
        F.struct(F.lit("lead_time_days").alias("field"), (d * 7).cast("string").alias("value"), F.concat(F.when(k % 2 == 0, F.lit("Lead time: 1-")).otherwise("needs "), d, F.when(k % 5 == 0, " days").otherwise(" weeks")).alias("text")),
        F.struct(F.lit("uom").alias("field"), F.lit("EA").alias("value"), F.when(k % 2 == 0, "5 pieces").otherwise("5 boxes").alias("text")),
        F.struct(F.lit("supplier_sku").alias("field"), F.concat(F.lit("AX."), k).alias("value"), F.concat(F.lit("part ax."), k, F.when(k % 4 == 0, "9").otherwise("!")).alias("text")),
        F.struct(F.lit("tax").alias("field"), F.lit("1234.56").alias("value"), F.when(k % 3 == 0, "tax 1.234,56 EUR").when(k % 3 == 1, "tax 1,234.56").otherwise("tax 1.234.56").alias("text")),
        F.struct(F.lit("moq").alias("field"), q.cast("string").alias("value"), F.to_json(F.struct(q.alias("row"), F.struct((q + 1).alias("qty"), F.when(k % 4 == 0, q).otherwise(q + 2).alias("MOQ")).alias("cells"))).alias("text")),
        F.struct(F.lit("currency").alias("field"), F.lit("EUR").alias("value"), F.to_json(F.struct(q.alias("row"), F.array(F.lit(" Currency "), F.when(k % 3 == 0, "eur").otherwise("USD")).alias("cells"))).alias("text")),
    )
    c = b.select("line_no", F.explode(cases).alias("c"))
    return c.groupBy("c.field", fe.supports(F.col("c.field"), F.col("c.value"), F.col("c.text")).alias("supported")).agg(F.count("*").alias("n"))


def cited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = a.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    nine = F.lit("0.9").cast("decimal(5,4)")
    ref = lambda s: F.struct(s.alias("source_text"), nine.alias("confidence"))
    snippet = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 3, 20)).otherwise(F.concat(F.substring("text", 3, 20), F.lit("\u0001")))
    refs = F.when(F.col("doc_id") % 5 != 0, F.create_map(F.lit("total"), ref(snippet), F.lit("tax"), ref(F.substring("text", 1, 4))))
    seen = fe.to_review(fe.cited(refs, F.col("text")), F.array(F.lit("tax")))
    return d.select("doc_id", seen["total"]["confidence"].cast("double").alias("total"), seen["tax"]["confidence"].cast("double").alias("tax"), fe.cited_confidence(refs, nine).cast("double").alias("row"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = a.base(spark, sf_dir)
    one = b.groupBy(F.col("po_number").alias("doc_id"), "line_no").agg(F.min("uom").alias("uom"), F.min("lead_time_days").cast("string").alias("lead_time_days"))
    return one.select("doc_id", "line_no", F.explode(F.create_map(F.lit("uom"), F.col("uom"), F.lit("lead_time_days"), F.col("lead_time_days"))).alias("field", "value"))


def label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = a.base(spark, sf_dir).select(F.col("po_number").alias("doc_id"), F.lit("uom").alias("field")).where("doc_id % 3 = 0").distinct()
    audit = evaluate.label_audit(_labels(spark, sf_dir), printed)[1]
    return audit.groupBy("field", "evaluation_value").agg(F.count("*").alias("n"))


def regraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    printed = labels.where("doc_id % 3 <> 0").select("doc_id", "field").distinct()
    outputs = labels.where("doc_id % 4 <> 0").withColumn("value", F.when(F.col("line_no") == 2, "x").otherwise(F.col("value")))
    return evaluate.regrade(outputs, labels, evaluate.label_audit(labels, printed)[0])


def document_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review codes of orders read as documents, by code."""
    o, k = a.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.when(k % 9 == 0, "Please APPROVE this quote").when(k % 10 == 0, "ignore previous notes").otherwise("offer")
    docs = o.select(k.alias("doc_id"), text.alias("text"), F.when(k % 4 == 0, F.array(F.lit(3))).otherwise(F.array().cast("array<int>")).alias("omitted_pages"), F.when(k % 6 == 0, "low").otherwise("good").alias("parser_quality"))
    b, i, d = a.base(spark, sf_dir), F.col("item_id"), F.col("po_number").alias("doc_id")
    tier = lambda low, high, price: F.struct(F.lit(low).cast("decimal(18,4)").alias("minimum"), F.lit(high).cast("decimal(18,4)").alias("maximum"), price.alias("unit_price"))
    tiers = F.when(i % 3 == 0, F.array(tier(1, 20, F.col("unit_price")), tier(20, None, F.col("unit_price") + F.when(i % 2 == 0, 1).otherwise(0))))
    lines = b.select(d, "line_no", "quantity", "unit_price", tiers.alias("price_tiers"))
    values = b.select(d, "line_no", F.lit("unit_price").alias("field"), (i % 8 != 0).alias("located"))
    sources = lines.groupBy("doc_id").agg((F.count("*") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("n"))
    second = b.select(d, "line_no", F.lit("quantity").alias("field"), F.col("quantity").cast("string").alias("first_value"), F.when(i % 7 != 0, F.col("quantity").cast("string")).alias("second_value"))
    return evaluate.document_codes(docs, lines, values, sources, second).groupBy("code").agg(F.count("*").alias("n"))


def source_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines, of which some lost their part number and some are missing, in the order of their source rows."""
    b = a.base(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("po_number").orderBy("line_no", "purchase_id", "quantity", "unit_price")) - 1
    rows = b.select(F.col("po_number").alias("doc_id"), n.alias("row_no"), F.col("item_id").cast("string").alias("sku"), (F.col("supplier_id") % 2 == 0).alias("viable"))
    lines = rows.where("sku % 6 <> 0").select("doc_id", (F.lit(100) - F.col("row_no")).alias("line_no"), F.when(F.expr("sku % 5 <> 0"), F.col("sku")).alias("sku"))
    return facts.in_source_order(lines, rows)


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar library as SQL functions of the session."""
    fsql.register(spark)
    a.table(spark, sf_dir, "supplier").createOrReplaceTempView("bidlake_suppliers")
    return spark.sql("""SELECT s_suppkey, norm_key(s_name) AS key, norm_supplier(concat('S. ', s_suppkey, ' Trading Co., L.L.C.')) AS supplier, norm_email(concat(' A', s_suppkey, '@B.org ')) AS email, email_domain(concat('x@', s_suppkey, '.Org')) AS domain,
      norm_subject(concat('Re: FWD: Offer ', s_suppkey)) AS subject, clean_sku(concat('AX - ', s_suppkey)) AS sku, norm_uom('Pieces') AS uom, rfq_token(concat('see RFQ #', 1000 + s_suppkey)) AS rfq, lead_days(concat(s_suppkey % 9 + 1, '-', s_suppkey % 9 + 2, ' weeks')) AS lead,
      cast(parse_number(concat('$1,', 200 + s_suppkey % 700, '.50')) AS DOUBLE) AS number, cast(money(s_suppkey / 3.0) AS DOUBLE) AS money FROM bidlake_suppliers""")


def corpus_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "customer").select(F.concat(F.when(F.col("c_custkey") % 4 == 0, "reliability-").otherwise("doc-"), "c_custkey").alias("case_id"), "c_nationkey")
    both = evaluate.subsets(c, "case_id")
    return both.groupBy("subset", "c_nationkey").agg(F.count("*").alias("n"))


def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = a.doc_lines(spark, sf_dir)
    text = F.when((F.col("doc_id") + F.col("line_no")) % 11 == 0, F.concat("line", F.lit(" Unit price and total quantity"))).otherwise(F.col("line"))
    pages = lines.withColumn("line", text).groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return facts.select_pages(pages, 3).groupBy("doc_id").agg(F.count_if("selected").alias("selected"), F.count("*").alias("pages"), F.max(F.when(F.col("page") == 1, F.col("selected"))).alias("first"))


def current_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _named(spark, sf_dir)
    r = changes.revisions(b.select("supplier_id", "po_number", "date").groupBy("supplier_id", "po_number").agg(F.min("date").alias("date")), ["supplier_id"], ["date", "po_number"], "po_number")
    kept = changes.effective_lines(b.withColumn("revision", F.concat_ws("|", "supplier_id", "po_number")), r.withColumn("revision", F.concat_ws("|", "supplier_id", "po_number")), "revision")
    return kept.groupBy("supplier_id", "po_number").agg(F.count("*").alias("lines"))


def folded_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's purchases of a month as an offer, its parts as lines; of two months out of three only the first part. Every line of every
    revision with its id, which is that of the offer that brought it."""
    b = a.base(spark, sf_dir).withColumn("month", F.date_format("date", "yyyy-MM"))
    sku = F.concat(F.when(F.month("date") % 2 == 0, "P-").otherwise("p-"), F.col("item_id") % 7)
    each = b.select("supplier_id", "month", F.month("date").alias("m"), F.lower(sku).alias("key"), F.struct(sku.alias("supplier_sku"), F.when(F.col("item_id") % 7 != 3, F.col("item_id") % 7).cast("string").alias("item_id"), F.lit("{}").alias("stated")).alias("line"))
    one = each.groupBy("supplier_id", "month", "m", "key").agg(F.min("line").alias("line"))
    lines = F.sort_array(F.collect_list("line"))
    offers = one.groupBy("supplier_id", "month", "m").agg(F.when(F.col("m") % 3 > 0, F.slice(lines, 1, 1)).otherwise(lines).alias("lines"))
    supplier = F.when(F.col("m") % 4 == 1, F.col("supplier_id")).cast("string")
    offers = offers.select(F.lit(a.TENANT).alias(ORG), F.col("supplier_id").alias("thread_id"), F.col("month").alias("email_id"), F.col("month").alias("sent_at"), supplier.alias("supplier_id"), F.lit(None).cast("string").alias("rfq_id"), "lines", F.lit("{}").alias("snapshot"))
    r = revisions.fold(offers)
    return r.select(F.col("thread_id").cast("long").alias("thread_id"), "revision_number", "email_id", "supersedes", "effective", (F.col("supplier_id") == F.col("thread_id")).alias("own"), "kept", "added", "dropped", F.explode("lines").alias("l")).select("*", "l.line_id", "l.supplier_sku", "l.item_id").drop("l")


def similar_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers, asked for by their alias or by their name with a letter before it and, for every third, one less behind."""
    s, k = a.suppliers(spark, sf_dir), F.col("supplier_id")
    spelled = lambda at: F.sha2(k.cast("string"), 256).substr(at, 12)
    known = s.select(ORG, "supplier_id", F.concat(spelled(1), F.lit(" Corp")).alias("name"), F.array(spelled(21)).alias("aliases"))
    wrong = F.concat(F.lit("x"), F.when(k % 3 == 1, spelled(1)).otherwise(spelled(1).substr(1, 11)), F.lit(" Ltd."))
    asked = s.select(ORG, k.alias("left_id"), F.when(k % 3 == 0, spelled(21)).otherwise(wrong).alias("text"))
    found = matching.possible_suppliers(asked, known)
    return found.select(F.col("left_id").alias("asked"), F.col("right_id").alias("supplier_id"), F.round("score", 6).alias("score"), "rank")


QUERIES = [
    email_intake, intake_offers, stored_intake, persisted_quotes, persisted_findings, pasted_emails, known_files, file_counts, page_counts, newest_alerts, bounded_rows, table_items, candidate_union, alias_union, text_functions, price_tiers, supported_values, cited_evidence,
    label_audit, regraded, document_review, source_alignment, sql_functions, corpus_subsets, selected_pages, current_lines, folded_revisions, similar_suppliers,
]

_MESSAGES = BASE + """,
e AS (
  SELECT concat_ws('-', purchase_id, CAST(quantity AS INT), unit_price) AS email_id, item_id + supplier_id AS k, supplier_id AS own, item_id, date,
         CASE (item_id + supplier_id) % 4 WHEN 2 THEN 'BUYER' ELSE 'SUPPLIER' END AS role, (item_id + supplier_id) % 7 <> 0 AS quoted,
         CASE WHEN (item_id + supplier_id) % 7 = 0 THEN 'INFORMATIONAL' WHEN (item_id + supplier_id) % 11 = 0 THEN 'QUOTE_REVISION' ELSE 'QUOTE' END AS kind
  FROM v_base),
m AS (
  SELECT *, CASE WHEN k % 4 IN (0, 1) THEN own END AS supplier_id, CASE k % 4 WHEN 0 THEN 'EXACT_CONTACT_EMAIL' WHEN 1 THEN 'KNOWN_ALIAS' WHEN 2 THEN 'SENDER_NOT_SUPPLIER' ELSE 'NEW_UNVERIFIED_CREATED' END AS method,
         CASE WHEN k % 5 <> 4 THEN item_id END AS rfq_id, CASE WHEN k % 4 = 3 THEN 'new|' || (k % 40) WHEN k % 4 <> 2 THEN own::VARCHAR END AS skey
  FROM e),
r AS (
  SELECT *, list_filter([CASE WHEN k % 4 = 2 THEN method END, CASE WHEN rfq_id IS NULL THEN 'UNMATCHED_RFQ' END, CASE WHEN NOT quoted THEN 'Email is not a supported quote workflow type' END,
         CASE WHEN NOT (quoted OR rfq_id IS NOT NULL) THEN 'No evidence-backed supplier quote fields found' END], lambda x: x IS NOT NULL) AS reasons, quoted AND role = 'SUPPLIER' AS offers FROM m)"""
_PERSISTED = BASE + """,
q AS (
  SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN (SELECT s_suppkey FROM supplier WHERE s_suppkey = o_orderkey % 700) WHEN 1 THEN (SELECT s_suppkey FROM supplier WHERE s_suppkey = o_orderkey % 70) END AS supplier_id,
         CASE WHEN o_orderkey % 4 = 0 THEN (SELECT p_partkey FROM part WHERE p_partkey = o_orderkey % 300) ELSE (SELECT p_partkey FROM part WHERE p_partkey = o_orderkey % 2500) END AS request_id
  FROM orders),
l AS (SELECT po_number AS doc_id, line_no, min(item_id) AS item_id FROM v_base GROUP BY ALL),
f AS (
  SELECT doc_id, NULL::INT AS line_no, 'SUPPLIER_UNMATCHED' AS code FROM q WHERE supplier_id IS NULL UNION ALL SELECT doc_id, line_no, 'SKU_UNMATCHED' FROM l WHERE line_no % 3 = 0
  UNION ALL SELECT doc_id, NULL, 'HISTORICAL_PRICE_ANOMALY' FROM q WHERE doc_id % 5 = 0 AND request_id IS NOT NULL)"""
_TABLES = BASE + """,
t AS (SELECT po_number::VARCHAR AS email_id, po_number AS k, row_number() OVER (PARTITION BY po_number ORDER BY line_no, purchase_id, quantity, unit_price) - 1 AS line_no, item_id, quantity, unit_price FROM v_base WHERE po_number % 5 <> 0),
i AS (
  SELECT email_id, line_no, 'supplier_sku' AS field, 'AX-' || item_id AS value FROM t UNION ALL SELECT email_id, line_no, 'quantity', CAST(CAST(CAST(quantity AS INT) * 100 AS DECIMAL(28,6)) AS VARCHAR) FROM t
  UNION ALL SELECT email_id, line_no, 'unit_price', CAST(CAST(CAST(unit_price AS DECIMAL(18,2)) AS DECIMAL(28,6)) AS VARCHAR) FROM t UNION ALL SELECT email_id, line_no, 'lead_time_days', '21' FROM t WHERE k % 3 = 0)"""
_LABELLED = BASE + """,
n AS (SELECT po_number AS doc_id, line_no, min(uom) AS uom FROM v_base GROUP BY ALL),
l AS (SELECT doc_id, line_no, 'uom' AS field FROM n UNION ALL SELECT doc_id, line_no, 'lead_time_days' FROM n)"""

SQL = {
    "email_intake": with_(
        _MESSAGES,
        """SELECT email_id, role AS sender_role, kind AS email_type, supplier_id, method AS supplier_method, rfq_id, CASE WHEN rfq_id IS NULL THEN 'UNMATCHED_RFQ' ELSE 'EXACT_RFQ_NUMBER' END AS rfq_method,
       CASE WHEN len(reasons) = 0 THEN 'COMPLETE' ELSE 'NEEDS_REVIEW' END AS status, array_to_string(reasons, '; ') AS status_reason, offers FROM r""",
    ),
    "stored_intake": with_(
        _MESSAGES + """,
t AS (SELECT *, rfq_id IS NULL AND quoted AS attached FROM m),
a AS (
  SELECT *, list_filter([CASE WHEN k % 4 = 2 THEN method END, CASE WHEN rfq_id IS NULL AND NOT attached THEN 'UNMATCHED_RFQ' END, CASE WHEN NOT quoted THEN 'kind' END,
         CASE WHEN NOT (quoted OR rfq_id IS NOT NULL) THEN 'nothing' END], lambda x: x IS NOT NULL) AS reasons FROM t)""",
        """SELECT email_id, CASE WHEN attached THEN item_id ELSE rfq_id END AS rfq_id, CASE WHEN rfq_id IS NULL AND NOT attached THEN 'UNMATCHED_RFQ' ELSE 'EXACT_RFQ_NUMBER' END AS rfq_method,
       CASE WHEN len(reasons) = 0 THEN 'COMPLETE' ELSE 'NEEDS_REVIEW' END AS status, 0 AS written_again FROM a""",
    ),
    "intake_offers": with_(
        _MESSAGES + """,
o AS (SELECT *, CASE WHEN rfq_id IS NULL THEN 'hello' ELSE 'rfq' END AS subject FROM r WHERE role = 'SUPPLIER'),
g AS (SELECT *, CASE WHEN coalesce(date > lag(date) OVER w + 30, true) THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY skey, rfq_id, subject ORDER BY date, '<' || email_id || '@x>')),
s AS (SELECT *, sum(new) OVER (PARTITION BY skey, rfq_id, subject ORDER BY date, '<' || email_id || '@x>') AS session FROM g)""",
        """SELECT email_id, supplier_id, rfq_id, (row_number() OVER w)::INT AS quote_no, lag(email_id) OVER w AS supersedes, lead(email_id) OVER w IS NULL AS effective, len(reasons) > 0 AS needs_review
FROM s WHERE offers WINDOW w AS (PARTITION BY skey, rfq_id, subject, session ORDER BY date, email_id)""",
    ),
    "persisted_quotes": with_(
        _PERSISTED,
        """SELECT doc_id, supplier_id, request_id, CASE WHEN doc_id IN (SELECT doc_id FROM f) THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence, doc_id IN (SELECT doc_id FROM f) AS needs_review,
       CASE WHEN supplier_id IS NULL OR request_id IS NULL THEN 'Review Required' ELSE 'Complete' END AS stage FROM q""",
    ),
    "persisted_findings": with_(_PERSISTED, "SELECT * FROM f"),
    "pasted_emails": """WITH c AS (SELECT c_custkey AS cust, c_custkey % 4 AS s FROM customer)
SELECT cust, cust % 3 = 0 AS is_message, CASE WHEN s = 0 THEN 'Firm ' || cust ELSE '' END AS sender_name, CASE s WHEN 0 THEN 'sales@firm' || cust || '.org' WHEN 1 THEN 'me' || cust || '@x.org' ELSE '' END AS sender_email,
       CASE s WHEN 0 THEN 'firm' || cust || '.org' WHEN 1 THEN 'x.org' ELSE '' END AS sender_domain, 'Offer ' || cust AS normalized_subject, '<id' || cust || '@h>' AS message_id, CASE WHEN cust % 2 = 1 THEN '<r@h>' END AS in_reply_to, 2 AS n_refs,
       CASE WHEN cust % 3 = 1 THEN 'just text ' || cust WHEN cust % 2 = 0 THEN 'own body' ELSE '' END AS body FROM c""",
    "known_files": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), s AS (SELECT h, min(doc_id) AS document_id FROM d WHERE doc_id % 2 = 1 GROUP BY h)
SELECT doc_id, document_id FROM d LEFT JOIN s USING (h)""",
    "file_counts": with_(BASE, "SELECT o_orderkey AS po_number, count(purchase_id) AS files FROM orders LEFT JOIN (SELECT * FROM v_base WHERE l_returnflag = 'R') ON po_number = o_orderkey GROUP BY 1"),
    "page_counts": with_(BASE, "SELECT supplier_id, count(*) AS total, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM v_base GROUP BY 1"),
    "newest_alerts": "SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id LIMIT 12",
    "bounded_rows": """WITH l AS (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents)
SELECT doc_id, least(5, count(*) FILTER (WHERE n % 3 <> 0 OR n % 2 = 0 OR n = 3)) AS shown, count(*) AS rows FROM l GROUP BY doc_id""",
    "table_items": with_(_TABLES, "SELECT email_id, line_no::INT AS line_no, field, value FROM i"),
    "candidate_union": with_(
        _TABLES + """,
k AS (SELECT email_id, line_no, row_number() OVER (PARTITION BY email_id ORDER BY line_no) - 1 AS place FROM (SELECT email_id, min(line_no) AS line_no FROM t GROUP BY email_id, item_id, CAST(quantity AS INT), CAST(unit_price AS DECIMAL(18,2))))""",
        """SELECT email_id, place::INT AS line_no, field, value FROM i JOIN k USING (email_id, line_no) UNION ALL SELECT o_orderkey::VARCHAR, NULL, 'currency', 'USD' FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 0, 'supplier_sku', o_orderkey::VARCHAR FROM orders WHERE o_orderkey::VARCHAR NOT IN (SELECT email_id FROM t) UNION ALL SELECT o_orderkey::VARCHAR, 0, 'moq', '1' FROM orders WHERE o_orderkey::VARCHAR NOT IN (SELECT email_id FROM t)
UNION ALL SELECT o_orderkey::VARCHAR, 1, 'supplier_sku', (o_orderkey + 1)::VARCHAR FROM orders WHERE o_orderkey::VARCHAR NOT IN (SELECT email_id FROM t)""",
    ),
    "alias_union": with_(
        BASE + ", n AS (SELECT supplier_id, 'Name ' || (item_id % 4) AS x FROM v_base WHERE line_no = 1 AND item_id % 3 <> 0 UNION SELECT s_suppkey, 'S' || s_suppkey || ' Ltd' FROM supplier)",
        "SELECT supplier_id, string_agg(x, ';' ORDER BY x) AS aliases FROM n GROUP BY 1",
    ),
    "text_functions": """SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN '<' || p_partkey || '@h>' WHEN 1 THEN 'id' || p_partkey || ' x' END AS message_id, 'q.pdf' AS filename,
  CASE WHEN p_partkey >= 18278 THEN chr(65 + ((p_partkey - 18278) // 17576 % 26)::INT) ELSE '' END || CASE WHEN p_partkey >= 702 THEN chr(65 + ((p_partkey - 702) // 676 % 26)::INT) ELSE '' END || CASE WHEN p_partkey >= 26 THEN chr(65 + ((p_partkey - 26) // 26 % 26)::INT) ELSE '' END || chr(65 + (p_partkey % 26)::INT) AS "column",
  sha256(p_name || chr(10) || chr(10) || p_partkey) AS hash, CASE WHEN p_partkey % 2 = 0 THEN 'Qty' ELSE trim(p_name) END AS label, p_partkey % 2000 BETWEEN 10 AND 999 AS suspect, 'AX-' || p_partkey || '/7, 12.5' AS repaired,
  CASE WHEN p_partkey % 4 = 0 THEN regexp_replace(p_name, '\\s+', ' ', 'g') || ' Supply Co' WHEN p_partkey % 3 = 1 THEN 'Bolt Works' ELSE 'Ann' END AS identity, CASE WHEN p_partkey % 2 = 0 THEN 'Juniper ' ELSE 'J uniper ' END || p_partkey AS joined FROM part""",
    "price_tiers": with_(
        BASE + """, t AS (SELECT 1::DECIMAL(28,6) AS minimum, (item_id * 10)::DECIMAL(28,6) AS maximum, CAST(CAST(unit_price AS DECIMAL(18,2)) AS DECIMAL(28,6)) AS unit_price FROM v_base
  UNION ALL SELECT item_id * 10 + 1, NULL, CAST(CAST(unit_price AS DECIMAL(18,2)) - 0.01 AS DECIMAL(28,6)) FROM v_base WHERE item_id % 2 = 0)""",
        "SELECT minimum, maximum, unit_price, count(*) AS n FROM t GROUP BY ALL",
    ),
    "supported_values": with_(
        BASE + """, s AS (SELECT 'quantity' AS field, item_id % 2 = 0 AS supported FROM v_base UNION ALL SELECT 'unit_price', item_id % 3 = 0 FROM v_base
  UNION ALL SELECT 'lead_time_days', item_id % 5 <> 0 FROM v_base UNION ALL SELECT 'uom', item_id % 2 = 0 FROM v_base UNION ALL SELECT 'supplier_sku', item_id % 4 <> 0 FROM v_base
  UNION ALL SELECT 'tax', item_id % 3 <> 2 FROM v_base UNION ALL SELECT 'moq', item_id % 4 = 0 FROM v_base UNION ALL SELECT 'currency', item_id % 3 = 0 FROM v_base)""",
        "SELECT field, supported, count(*) AS n FROM s GROUP BY ALL",
    ),
    "cited_evidence": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0 END::DOUBLE AS total, CASE WHEN doc_id % 5 <> 0 THEN 0.5 END::DOUBLE AS tax, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 0.9 END::DOUBLE AS "row" FROM documents""",
    "label_audit": with_(_LABELLED, "SELECT field, NULL::VARCHAR AS evaluation_value, count(*) AS n FROM l WHERE NOT (field = 'uom' AND doc_id % 3 = 0) GROUP BY 1"),
    "regraded": with_(
        _LABELLED + """,
s AS (SELECT doc_id, field, doc_id % 4 <> 0 AND line_no <> 2 AS was, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 4 <> 0 AND line_no <> 2 ELSE doc_id % 4 = 0 END AS now FROM l)""",
        "SELECT doc_id, field, count(*) FILTER (WHERE was) AS correct_before, count(*) FILTER (WHERE now) AS correct_after, count(*) AS total FROM s GROUP BY ALL HAVING count(*) FILTER (WHERE was) <> count(*) FILTER (WHERE now)",
    ),
    "document_review": with_(
        BASE + """,
o AS (SELECT o_orderkey AS k FROM orders),
c AS (
  SELECT 'PAGES_OMITTED' AS code FROM o WHERE k % 4 = 0 UNION ALL SELECT 'OCR_QUALITY' FROM o WHERE k % 6 = 0 UNION ALL SELECT 'UNTRUSTED_INSTRUCTION' FROM o WHERE k % 9 = 0 OR k % 10 = 0
  UNION ALL SELECT 'TIER_PRICE_REVIEW' FROM v_base WHERE item_id % 3 = 0 AND (quantity = 20 OR (quantity > 20 AND item_id % 2 = 0)) UNION ALL SELECT 'SOURCE_EVIDENCE_ERROR' FROM v_base WHERE item_id % 8 = 0
  UNION ALL SELECT 'SOURCE_LINE_COUNT_MISMATCH' FROM o WHERE k % 5 = 0 AND k IN (SELECT po_number FROM v_base) UNION ALL SELECT 'SECOND_PASS_DISAGREEMENT' FROM v_base WHERE item_id % 7 = 0)""",
        "SELECT code, count(*) AS n FROM c GROUP BY code",
    ),
    "sql_functions": """SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS key, 's' || s_suppkey || 'tradingco' AS supplier, 'a' || s_suppkey || '@b.org' AS email, s_suppkey || '.org' AS domain, 'Offer ' || s_suppkey AS subject, 'AX-' || s_suppkey AS sku, 'EA' AS uom,
      'RFQ-' || (1000 + s_suppkey) AS rfq, ((s_suppkey % 9 + 2) * 7)::INT AS lead, (1200 + s_suppkey % 700 + 0.5)::DOUBLE AS number, round(s_suppkey / 3.0::DECIMAL(18,6), 2)::DOUBLE AS money FROM supplier""",
    "corpus_subsets": "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'reliability' ELSE 'standard' END AS subset, c_nationkey, count(*) AS n FROM customer GROUP BY ALL",
    "selected_pages": """WITH l AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents) SELECT doc_id, least(3, (n + 39) // 40) AS selected, (n + 39) // 40 AS pages, true AS first FROM l""",
    "current_lines": with_(
        BASE + """,
o AS (SELECT supplier_id, po_number, min(date) AS date, count(*) AS lines FROM v_base GROUP BY ALL)""",
        "SELECT supplier_id, po_number, lines FROM o QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY date DESC, po_number DESC) = 1",
    ),
    "folded_revisions": """WITH RECURSIVE """ + BASE.strip() + """,
one AS (
  SELECT supplier_id, strftime(date, '%Y-%m') AS month, month(date) AS m, item_id % 7 AS r FROM v_base GROUP BY ALL),
o AS (
  SELECT supplier_id, month, m, row_number() OVER (PARTITION BY supplier_id ORDER BY month) AS n,
         CASE WHEN m % 3 > 0 THEN list(r ORDER BY r)[1:1] ELSE list(r ORDER BY r) END AS parts FROM one GROUP BY supplier_id, month, m),
f AS (
  SELECT supplier_id, 0::BIGINT AS n, NULL::VARCHAR AS month, NULL::VARCHAR AS before, 0::BIGINT AS m, []::BIGINT[] AS parts, []::VARCHAR[] AS ids, []::VARCHAR[] AS items, 0::BIGINT AS kept, 0::BIGINT AS dropped, false AS own
  FROM (SELECT DISTINCT supplier_id FROM o)
  UNION ALL
  SELECT o.supplier_id, o.n, o.month, f.month, o.m, o.parts,
         list_transform(o.parts, lambda x, i: coalesce(f.ids[list_position(f.parts, x)], CASE WHEN len(f.parts) = 1 AND len(o.parts) = 1 THEN f.ids[1] END, o.month || ':' || i)),
         list_transform(o.parts, lambda x: coalesce(CASE WHEN x <> 3 THEN x::VARCHAR END, f.items[list_position(f.parts, x)], CASE WHEN len(f.parts) = 1 AND len(o.parts) = 1 THEN f.items[1] END)),
         len(list_filter(o.parts, lambda x: list_contains(f.parts, x) OR (len(f.parts) = 1 AND len(o.parts) = 1))),
         len(f.parts) - len(list_filter(o.parts, lambda x: list_contains(f.parts, x) OR (len(f.parts) = 1 AND len(o.parts) = 1))), f.own OR o.m % 4 = 1
  FROM f JOIN o ON o.supplier_id = f.supplier_id AND o.n = f.n + 1),
l AS (SELECT *, unnest(parts) AS part, unnest(ids) AS line_id, unnest(items) AS item_id FROM f WHERE n > 0)
SELECT supplier_id AS thread_id, n::INT AS revision_number, month AS email_id, before AS supersedes, n = max(n) OVER (PARTITION BY supplier_id) AS effective, CASE WHEN own THEN true END AS own,
       kept::INT AS kept, (len(parts) - kept)::INT AS added, dropped::INT AS dropped, line_id, CASE WHEN m % 2 = 0 THEN 'P-' ELSE 'p-' END || part AS supplier_sku, item_id FROM l""",
    "similar_suppliers": "SELECT s_suppkey AS asked, s_suppkey AS supplier_id, CASE s_suppkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.96 ELSE round(22 / 24, 6) END::DOUBLE AS score, 1 AS rank FROM supplier",
}
