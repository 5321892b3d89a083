"""Messages as they come: kinds, history, signatures, offers, and the intake of a few of them from end to end."""

import datetime

import pytest
from pyspark.sql import functions as F

from bidlake.functions import evidence as fe
from bidlake.functions import text as ft
from bidlake.operators import facts, intake, mail, matching


def of(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("subject", "body", "kind"),
    [
        ("Hi", "Could you do a lower price?", "NEGOTIATION"),
        ("Hi", "Our final quotation supersedes the last.", "QUOTE_REVISION"),
        ("Hi", "See you Monday.", "INFORMATIONAL"),
        ("Hi", " \n", "UNKNOWN"),
        ("Your quotation", "attached", "QUOTE"),
        ("Request for quote", "", "QUOTE"),
        ("RFQ response", "", "RFQ_RESPONSE"),
        ("Order confirmation", "", "ORDER_CONFIRMATION"),
    ],
)
def test_kinds(spark, subject, body, kind):
    assert of(spark, ft.classify_email(F.col("s"), F.col("b")), s=subject, b=body) == kind


@pytest.mark.parametrize(
    ("body", "current", "history"),
    [
        ("We offer 5.\nOn Monday, Ann wrote:\n> old", "We offer 5.", "On Monday, Ann wrote:\n> old"),
        ("a\r\n-- Original Message --\r\nb", "a", "-- Original Message --\nb"),
        ("a\nFrom: x@y.org\nb", "a", "From: x@y.org\nb"),
        ("a\n______\nb", "a", "______\nb"),
        ("On time as you wrote: fine", "On time as you wrote: fine", ""),
        ("> all quoted", "", "> all quoted"),
    ],
)
def test_history(spark, body, current, history):
    got = of(spark, ft.split_history(F.col("b")), b=body)
    assert (got["body"], got["history"]) == (current, history)


@pytest.mark.parametrize(
    ("body", "current", "signature"),
    [
        ("Thanks,\nprice is 5", "Thanks,\nprice is 5", ""),
        ("Regards to the team\nprice is 5", "Regards to the team\nprice is 5", ""),
        ("price is 5\nBest regards,\nAnn", "price is 5", "Best regards,\nAnn"),
        ("price is 5\n-- \nAnn", "price is 5", "-- \nAnn"),
        ("price\nThanks!\nAnn", "price", "Thanks!\nAnn"),
    ],
)
def test_signature(spark, body, current, signature):
    got = of(spark, ft.split_signature(F.col("b")), b=body)
    assert (got["body"], got["signature"]) == (current, signature)


def candidates(spark, body, role="SUPPLIER"):
    df = spark.createDataFrame([("m", role, "", body)], "email_id string, sender_role string, subject string, body string")
    return {(r["line_no"], r["field"]): r["value"] for r in mail.email_candidates(df).collect()}


def test_conditional_offers_state_nothing_else(spark):
    got = candidates(spark, "qty 10, unit price 5\nIf you order 500 the unit price 1.25, qty 500, MOQ 200, lead time 9 days")
    assert {k[1]: v for k, v in got.items()} == {"quantity": "10.000000", "unit_price": "5.000000", "price_tiers": "500.000000@1.250000"}


def test_mentions_are_no_items(spark):
    got = candidates(spark, "AX-10\nAX-20\nqty 3\nAX-30")
    assert {k: v for k, v in got.items() if k[0] is not None} == {(0, "supplier_sku"): "AX-20", (0, "quantity"): "3.000000", (1, "supplier_sku"): "AX-30"}
    assert not any(k[0] is not None for k in candidates(spark, "AX-10 qty 5", "BUYER"))


def test_table_heads(spark):
    rows = [("m", 0, 0, ["Item list", ""]), ("m", 0, 1, ["SKU", "Qty."]), ("m", 0, 2, ["A-1", "1,000"]), ("m", 0, 3, [" ", " "]), ("m", 0, 4, ["Description", "Unit Price"]), ("m", 0, 5, ["Bolt", "$2.50"]), ("m", 1, 0, ["x", "y"])]
    df = spark.createDataFrame(rows, "email_id string, table_no int, row_no int, cells array<string>")
    got = sorted((r["line_no"], r["field"], r["value"]) for r in intake.table_items(df).collect())
    assert got == [(0, "quantity", "1000.000000"), (0, "supplier_sku", "A-1"), (1, "description", "Bolt"), (1, "unit_price", "2.500000")]


ORG = "organization_id"


def test_intake(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    offer = "Quote no. Q7\nAX-10\nqty 5, unit price 2"
    mails = [
        ("e1", "<1>", [], "Ann", "Ann@bolts.example", "Re: RFQ-100", offer, day(1)),
        ("e2", "<2>", ["<1>"], "Ann", "ann@bolts.example", "Re: RFQ-100", "Revised quotation\n" + offer, day(2)),
        ("e3", "<3>", [], "Bob", "bob@own.example", "RFQ-100", offer, day(3)),
        ("e4", "<4>", [], "Eve", "eve@gmail.com", "RFQ-100", offer, day(4)),
        ("e5", "<5>", [], "Cid", "cid@new.example", "hello", "See you Monday.\n\nBest regards\nCid\nFresh Components GmbH", day(5)),
        ("e6", "<6>", [], "Dan", "dan@other.example", "RFQ-100 and RFQ-200", offer + "\nsee RFQ-200", day(6)),
        ("e7", "<7>", [], "Bolt Wroks Inc", "sales@wroks.example", "RFQ-100", offer, day(7)),
        ("e8", "<8>", [], None, None, "RFQ-100", offer, day(8)),
    ]
    e = spark.createDataFrame([("o", *m, None) for m in mails], f"{ORG} string, email_id string, message_id string, refs array<string>, sender_name string, sender_email string, subject string, body string, sent_at timestamp, rfq_id long")
    users = spark.createDataFrame([("o", "bob@own.example")], f"{ORG} string, email string")
    suppliers = spark.createDataFrame([("o", 1, "Bolts Ltd", ["Bolt People"], "bolts.example"), ("o", 2, "Bolt Works Inc", [], "works.example"), ("o", 3, "Other", [], "other.example")], f"{ORG} string, supplier_id long, name string, aliases array<string>, email_domain string")
    contacts = spark.createDataFrame([("o", 1, "ann@bolts.example")], f"{ORG} string, supplier_id long, email string")
    rfqs = spark.createDataFrame([("o", 10, "RFQ-100"), ("o", 20, "RFQ-200")], f"{ORG} string, rfq_id long, number string")
    attached = spark.createDataFrame([("e1", 1, 0, "unit_price", "3.000000"), ("e1", 1, 0, "supplier_sku", "AX-10")], "email_id string, ordinal int, line_no int, field string, value string")
    messages, offers, conflicts = intake.email_intake(e, users, suppliers, contacts, rfqs, attached)
    got = {r["email_id"]: r for r in messages.collect()}
    assert {k: (r["sender_role"], r["email_type"], r["supplier_id"], r["supplier_method"], r["rfq_id"], r["rfq_method"]) for k, r in got.items()} == {
        "e1": ("SUPPLIER", "QUOTE", 1, "EXACT_CONTACT_EMAIL", 10, "EXACT_RFQ_NUMBER"), "e2": ("SUPPLIER", "QUOTE_REVISION", 1, "EXACT_CONTACT_EMAIL", 10, "EXACT_RFQ_NUMBER"), "e3": ("BUYER", "QUOTE", None, "SENDER_NOT_SUPPLIER", 10, "EXACT_RFQ_NUMBER"),
        "e4": ("SUPPLIER", "QUOTE", None, "SUPPLIER_IDENTITY_REVIEW_REQUIRED", 10, "EXACT_RFQ_NUMBER"), "e5": ("SUPPLIER", "INFORMATIONAL", None, "NEW_UNVERIFIED_CREATED", None, "UNMATCHED_RFQ"), "e6": ("SUPPLIER", "QUOTE", 3, "EXACT_VERIFIED_DOMAIN", None, "AMBIGUOUS_RFQ"),
        "e7": ("SUPPLIER", "QUOTE", None, "POSSIBLE_EXISTING_SUPPLIER", 10, "EXACT_RFQ_NUMBER"), "e8": ("UNKNOWN", "QUOTE", None, "SENDER_NOT_SUPPLIER", 10, "EXACT_RFQ_NUMBER"),
    }
    assert got["e1"]["status_reason"] == "Field conflict requires review." and got["e2"]["status"] == "COMPLETE"
    assert got["e5"]["status_reason"] == "UNMATCHED_RFQ; Email is not a supported quote workflow type; No evidence-backed supplier quote fields found"
    assert got["e8"]["status_reason"] == "Missing From header; SENDER_NOT_SUPPLIER"
    assert got["e1"]["thread"] == got["e2"]["thread"] != got["e3"]["thread"]
    made = {r["email_id"]: (r["quote_no"], r["supersedes"], r["effective"]) for r in offers.collect()}
    assert made["e1"] == (1, None, False) and made["e2"] == (2, "e1", True) and set(made) == {"e1", "e2", "e4", "e6", "e7"}
    assert [(r["email_id"], r["field"], r["resolution"]) for r in conflicts.collect()] == [("e1", "line_items.ax-10.unit_price", "REVIEW_REQUIRED")]


def test_supports(spark):
    cases = [
        ("quantity", "1000", "qty 1,000 pcs", True), ("quantity", "1000", "SKU-1000", False), ("unit_price", "2.5", "at 2,50 each", True), ("lead_time_days", "14", "Lead time: 1-2 weeks", True), ("lead_time_days", "3", "lead time: 2 weeks, then 3 days", False),
        ("lead_time_days", "3", "in 3 days", True), ("uom", "EA", "five pieces", True), ("uom", "EA", "five boxes", False), ("supplier_sku", "A.1", "part a.1, new", True), ("supplier_sku", "A.1", "part a.12", False), ("currency", None, "USD", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, field string, value string, text string, want boolean")
    got = df.select("i", "want", fe.supports(F.col("field"), F.col("value"), F.col("text")).alias("got")).collect()
    assert [r["i"] for r in got if r["want"] != r["got"]] == []


def test_tiers_names_and_columns(spark):
    tiers = of(spark, fe.price_tiers(F.col("t")), t="1-49: USD 2.50; 50 – 1,000 = 2; 1001+: $1.75")
    assert [tuple(None if x is None else float(x) for x in t) for t in tiers] == [(1, 49, 2.5), (50, 1000, 2), (1001, None, 1.75)]
    assert of(spark, fe.price_tiers(F.col("t")), t="no prices") == []
    assert of(spark, fe.joined_name(F.col("t"), F.lit(True)), t="J uniper Supply") == "Juniper Supply" and of(spark, fe.joined_name(F.col("t"), F.lit(True)), t="A I Works") == "A I Works"
    names = spark.range(20_000).select(ft.column_name(F.col("id")).alias("n")).collect()

    def name(i):
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    assert [r["n"] for r in names] == [name(i) for i in range(20_000)]


def test_suppliers_with_many_aliases(spark):
    s = spark.createDataFrame([("o", 1, "Bolt Works", [f"Bolt Work {i}" for i in range(20)]), ("o", 2, "Bolt Workz", []), ("o", 3, "Bolt Worky", [])], f"{ORG} string, supplier_id long, name string, aliases array<string>")
    asked = spark.createDataFrame([("o", "q", "Bolt Works")], f"{ORG} string, left_id string, text string")
    assert {r["right_id"] for r in matching.possible_suppliers(asked, s).collect()} == {1, 2, 3}


def test_thread_of_a_long_chain(spark):
    from bidlake.operators import changes

    m = spark.createDataFrame([("o", f"m{i:03d}", [f"m{i - 1:03d}"] if i else []) for i in range(300)] + [("o", "z", ["gone"])], f"{ORG} string, message_id string, refs array<string>")
    assert {(r["message_id"] == "z", r["root"]) for r in changes.thread_roots(m).collect()} == {(False, "m000"), (True, "z")}


def test_source_rows_in_order(spark):
    lines = spark.createDataFrame([("d", 0, "B"), ("d", 1, None), ("d", 2, "Z")], "doc_id string, line_no int, sku string")
    rows = spark.createDataFrame([("d", 0, "A", True), ("d", 1, "B", True), ("d", 2, "C", False), ("d", 3, "D", True)], "doc_id string, row_no int, sku string, viable boolean")
    got = [(r["position"], r["row_no"], r["line_no"]) for r in sorted(facts.in_source_order(lines, rows).collect(), key=lambda r: r["position"])]
    assert got == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, None)]


def test_attachments_name_supplier_and_request(spark, tmp_path):
    """An attachment decides what the message leaves open; a second run over the same messages writes nothing."""
    at = datetime.datetime(2024, 1, 1)
    offer = "Quote no. Q7\nAX-10\nqty 5, unit price 2"
    mails = [("o", "e1", "<1>", [], None, "x@gmail.com", "hello", offer, at, None), ("o", "e2", "<2>", [], None, "y@gmail.com", "hello", offer, at, None)]
    e = spark.createDataFrame(mails, f"{ORG} string, email_id string, message_id string, refs array<string>, sender_name string, sender_email string, subject string, body string, sent_at timestamp, rfq_id long")
    users = spark.createDataFrame([], f"{ORG} string, email string")
    suppliers = spark.createDataFrame([("o", 1, "Bolts Ltd", ["Bolt People"], "bolts.example")], f"{ORG} string, supplier_id long, name string, aliases array<string>, email_domain string")
    contacts = spark.createDataFrame([], f"{ORG} string, supplier_id long, email string")
    rfqs = spark.createDataFrame([("o", 10, "RFQ-100"), ("o", 20, "RFQ-200")], f"{ORG} string, rfq_id long, number string")
    attached = spark.createDataFrame([("e1", 2, None, "supplier_name", "Other"), ("e1", 1, None, "supplier_name", "Bolts Limited")], "email_id string, ordinal int, line_no int, field string, value string")
    texts = spark.createDataFrame([("e1", 1, "see RFQ-100"), ("e1", 2, "rfq-100 again"), ("e2", 1, "RFQ-100"), ("e2", 2, "RFQ-200"), ("e2", 3, None)], "email_id string, ordinal int, text string")
    out = intake.email_intake(e, users, suppliers, contacts, rfqs, attached, attachment_texts=texts)
    got = {r["email_id"]: (r["supplier_id"], r["rfq_id"], r["rfq_method"]) for r in out[0].collect()}
    assert got == {"e1": (1, 10, "EXACT_RFQ_NUMBER"), "e2": (None, None, "AMBIGUOUS_RFQ")}
    folder = str(tmp_path)
    for epoch in (0, 0, 1):
        intake.store_intake(*out, folder, epoch)
    rows = intake.stored(spark, folder, "messages").collect()
    assert {r["email_id"] for r in rows} == {"e1", "e2"} and {r["epoch"] for r in rows} == {0} and intake.stored(spark, folder, "messages", 0).count() == 0
