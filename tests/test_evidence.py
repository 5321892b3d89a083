"""Evidence: literal support, where it stands, and offers folded into a quote."""

import json

from pyspark.sql import functions as F

from bidlake.functions import evidence as fe
from bidlake.operators import locate, revisions

ROWS = "doc_id long, page int, row_no int, raw string"
VALUES = "doc_id long, line_no int, field string, value string"


def test_supports_numbers_and_cells(spark):
    cells = lambda x, **more: json.dumps({"row": 7, **more, "cells": x})
    cases = [
        ("unit_price", "1234.56", "price 1.234,56 EUR", True), ("unit_price", "1234.56", "1,234.56", True), ("unit_price", "1234567.8", "1.234.567,8", True),
        ("unit_price", "12.5", "12,50", True), ("unit_price", "1234", "1,234", True), ("unit_price", "1.5", "1.234.5", False), ("unit_price", "5", "v5", False),
        ("quantity", "7", cells({"qty": "5"}), False), ("quantity", "9", cells({"qty": "5", "moq": "9"}), False), ("quantity", "5", cells({" QTY ": "5", "moq": "9"}), True),
        ("quantity", "9", cells({"amount": "9"}), True), ("tax", "3", cells(["Tax", "3"]), True), ("tax", "2", cells(["a", 2, None]), True), ("currency", "currency", cells(["Currency", "EUR"]), False),
        ("quantity", "5", '{"cells": 5} and more', True), ("quantity", "5", "[5]", True), ("quantity", "5", None, False), ("supplier_name", "née", "Née & Co", True),
        ("lead_time_days", "14", cells({"lead time": "2 weeks", "x": "3 days"}), True), ("lead_time_days", "3", cells({"lead time": "2 weeks", "x": "3 days"}), False),
        ("uom", "EA", cells({"uom": "boxes", "qty": "5 pcs"}), False), ("uom", "KG", "kilogram", True), ("uom", "KG", "kilograms", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, field string, value string, text string, want boolean")
    got = df.select("i", "want", fe.supports(F.col("field"), F.col("value"), F.col("text")).alias("got")).collect()
    assert [(r["i"], cases[r["i"]]) for r in got if r["want"] != r["got"]] == []


def test_where_evidence_stands(spark):
    rows = [
        "Vendor: Acme", "", "LINE ITEM 1", "SKU: AX-1", "Quantity: 5", "Unit price: 5", "note 12", "LINE ITEM 2", "SKU: AX-1", "Quantity: 7", "moq 5", "Subtotal: 12", "AX-2 | 3 boxes | 9,5", "Shipping: 12",
    ]
    table = spark.createDataFrame([(1, 1 + (i > 6), i, r) for i, r in enumerate(rows)] + [(2, 1, 0, "AX-1 5")], ROWS)
    values = [
        (1, 0, "supplier_name", "acme"), (1, 0, "shipping_cost", "12"), (1, 0, "tax", "12"), (1, 0, "currency", None),
        (1, 1, "supplier_sku", "AX-1"), (1, 1, "quantity", "5"), (1, 1, "unit_price", "5"), (1, 1, "moq", "12"),
        (1, 2, "supplier_sku", "AX-1"), (1, 2, "quantity", "7"), (1, 2, "moq", "5"), (1, 2, "unit_price", "12"),
        (1, 3, "supplier_sku", "AX-1"), (1, 3, "quantity", "5"),
        (1, 4, "supplier_sku", "AX-2"), (1, 4, "uom", "BOX"), (1, 4, "unit_price", "9.50"),
        (1, 5, "supplier_sku", "AX"), (1, 5, "quantity", "3"), (1, 6, "quantity", "5"), (2, 1, "supplier_sku", "ZZ"), (2, 1, "quantity", "5"), (2, 0, "tax", "--"),
    ]
    got = locate.evidence(spark.createDataFrame(values, VALUES), table, spark.createDataFrame([(1, 2), (2, 8), (2, 9)], "doc_id long, page int")).collect()
    at = {(r["doc_id"], r["line_no"], r["field"]): (r["row_no"], r["evidence_type"]) for r in got}
    assert len(got) == len(values)
    visual, none = (None, "visual"), (None, None)
    assert at == {
        (1, 0, "supplier_name"): (0, "text"), (1, 0, "shipping_cost"): (13, "ocr"), (1, 0, "tax"): (6, "text"), (1, 0, "currency"): none,
        (1, 1, "supplier_sku"): (3, "text"), (1, 1, "quantity"): (4, "text"), (1, 1, "unit_price"): (5, "text"), (1, 1, "moq"): (6, "text"),
        (1, 2, "supplier_sku"): (8, "ocr"), (1, 2, "quantity"): (9, "ocr"), (1, 2, "moq"): (10, "ocr"), (1, 2, "unit_price"): visual,
        (1, 3, "supplier_sku"): (8, "ocr"), (1, 3, "quantity"): visual,
        (1, 4, "supplier_sku"): (12, "ocr"), (1, 4, "uom"): (12, "ocr"), (1, 4, "unit_price"): (12, "ocr"),
        (1, 5, "supplier_sku"): (3, "text"), (1, 5, "quantity"): visual, (1, 6, "quantity"): visual, (2, 1, "supplier_sku"): none, (2, 1, "quantity"): none, (2, 0, "tax"): none,
    }
    assert locate.evidence(spark.createDataFrame([], VALUES), table, spark.createDataFrame([], "doc_id long, page int")).count() == 0


def test_fold(spark):
    line = lambda sku, item=None, price="1": (sku, item, json.dumps({"price": price}))
    offers = [
        ("o", "t", "e1", 1, "s", None, [line("A", "i1"), line("B")], "1"), ("o", "t", "e2", 2, None, "r", [line("a", None, "2"), line("C"), line("C")], "2"),
        ("o", "t", "e3", 3, None, None, [line("c", "i3")], "3"), ("o", "t", "e4", 4, "z", None, [line(None)], "4"), ("o", "t", "e5", 5, None, None, None, "5"), ("o", "t", "e6", 6, None, None, [line("D"), line("d", "i4")], "6"),
        ("o", "t", "e7", 7, None, None, [line("d", None, "3"), line("D", None, "4")], "7"), ("o", None, "x", None, None, None, [line("A")], None), ("p", "t", "e1", 1, None, None, [line("A")], "1"),
    ]
    schema = "organization_id string, thread_id string, email_id string, sent_at int, supplier_id string, rfq_id string, lines array<struct<supplier_sku:string,item_id:string,stated:string>>, snapshot string"
    got = {(r["organization_id"], r["thread_id"], r["email_id"]): r for r in revisions.fold(spark.createDataFrame(offers, schema)).collect()}
    assert len(got) == len(offers)
    lines = {e: [(x["line_id"], x["supplier_sku"], x["item_id"]) for x in got["o", "t", e]["lines"]] for e in ("e1", "e2", "e3", "e4", "e5", "e6", "e7")}
    assert lines["e1"] == [("e1:1", "A", "i1"), ("e1:2", "B", None)]
    assert lines["e2"] == [("e1:1", "a", "i1"), ("e2:2", "C", None), ("e2:3", "C", None)]
    assert lines["e3"] == [("e2:3", "c", "i3")] and lines["e4"] == [("e2:3", None, "i3")] and lines["e5"] == []
    assert lines["e6"] == [("e6:1", "D", None), ("e6:2", "d", "i4")]
    assert lines["e7"] == [("e6:2", "D", "i4")] and json.loads(got["o", "t", "e7"]["lines"][0]["stated"]) == {"price": "4"}
    counts = {e: tuple(got["o", "t", e][c] for c in ("revision_number", "supersedes", "effective", "supplier_id", "rfq_id", "kept", "added", "dropped", "snapshot", "quote_id")) for e in lines}
    assert counts["e2"] == (2, "e1", False, "s", "r", 1, 2, 1, "2", "e1") and counts["e4"][3:8] == ("z", "r", 1, 0, 0)
    assert counts["e7"] == (7, "e6", True, "z", "r", 1, 0, 1, "7", "e1") and got["p", "t", "e1"]["effective"] and got["o", None, "x"]["revision_number"] == 1
    assert revisions.fold(spark.createDataFrame([], schema)).count() == 0
