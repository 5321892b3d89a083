"""Small cases of confirmations, decisions, model output and the parser report."""

from bidlake.operators import confirm, evaluate


def test_model_output(spark):
    rows = [
        (1, '{"supplier":"A","valid_until":"March 4, 2026","items":[{"sku":"x","quantity":5,"unit_price":"1.1234567","note":"?"},{"supplier_sku":"","delivery_date":"2026-01-02"}],"number_format":"US","extra":1}'),
        (2, '{"supplier":"A","supplier_name":"B","line_items":null}'), (3, "[1]"), (4, "no"), (5, None), (6, '{"line_items":[3]}'),
    ]
    got = {r["doc_id"]: r for r in confirm.model_output(spark.createDataFrame(rows, "doc_id int, content string")).collect()}
    assert got[1]["error"] is None and got[1]["quote"] == {"supplier_name": "A", "expiration_date": "2026-03-04"}
    assert got[1]["lines"] == [{"supplier_sku": "x", "quantity": "5"}, {"delivery_date": "2026-01-02"}]
    assert set(got[1]["normalized"]) == {"removed_number_format", "supplier_to_supplier_name", "valid_until_to_expiration_date", "items_to_line_items", "sku_to_supplier_sku", "line.supplier_sku_empty_to_null"}
    assert sorted(got[1]["discarded"]) == ["line.note", "quote.extra"] and got[1]["review"] == ["line_items.0.unit_price"]
    assert got[2]["quote"] == {"supplier_name": "B"} and got[2]["lines"] == [] and got[2]["discarded"] == ["quote.supplier"]
    assert [got[i]["error"] for i in (3, 4, 5, 6)] == ["NO_OBJECT", "NO_OBJECT", "NO_OBJECT", "BAD_LINE"] and got[3]["quote"] is None


def test_confirmations(spark):
    c = spark.createDataFrame([("q", "line_items.0.quantity", "REVIEW_REQUIRED", "1,000"), ("q", "currency", "REVIEW_REQUIRED", "usd"), ("r", "currency", "ACCEPTED", "USD"), ("s", "currency", "REVIEW_REQUIRED", "USD")], "quote_id string, path string, decision string, raw_candidate string")
    a = spark.createDataFrame([("q", "line_items.0.quantity", "1000.0"), ("q", "currency", "USD"), ("r", "currency", "USD"), ("s", "currency", "USD"), ("s", "tax", "1")], "quote_id string, path string, value string")
    got = {(r["quote_id"], r["path"]): (r["refused"], r["confirmed"]) for r in confirm.confirmations(c, a).collect()}
    assert got == {("q", "line_items.0.quantity"): (None, True), ("q", "currency"): (None, True), ("r", "currency"): ("NOT_THE_CANDIDATE", False), ("s", "currency"): (None, False), ("s", "tax"): ("UNKNOWN_FIELD", False)}


def test_decisions(spark):
    e = spark.createDataFrame([("a", None, "NEW"), ("b", "s1", "NEW"), ("c", None, "NEW")], "email_id string, supplier_id string, status string")
    rows = [("a", 1, "VERIFY", None), ("a", 2, "CREATE_NEW", None), ("a", 3, "VERIFY", None), ("b", 4, "CREATE_NEW", None), ("b", 5, "USE_EXISTING", "s2"), ("b", 6, "USE_EXISTING", "s9"), ("b", 7, "REVIEW_LATER", None)]
    d = spark.createDataFrame([(m, i, i, x, s) for m, i, x, s in rows], "email_id string, decision_id int, decided_at int, action string, supplier_id string")
    mails, suppliers, log = confirm.apply_decisions(e, d, spark.createDataFrame([("s1",), ("s2",)], "supplier_id string"))
    assert {r["email_id"]: (r["supplier_id"], r["status"]) for r in mails.collect()} == {"a": ("new-a", "NEW"), "b": ("s2", "NEEDS_REVIEW"), "c": (None, "NEW")}
    assert {tuple(r) for r in suppliers.collect()} == {("new-a", "VERIFIED")}
    assert {r["decision_id"]: r["refused"] for r in log.collect() if r["refused"]} == {1: "NO_SUPPLIER", 4: "HAS_SUPPLIER", 6: "UNKNOWN_SUPPLIER"}


def test_parser_matrix(spark):
    rows = spark.createDataFrame([("p", "d", 1, ["SKU", "Qty", "Unit price"]), ("p", "d", 2, ["A-1", "5,000", "4.50"]), ("p", "d", 3, ["B-2", "7", "9"]), ("p", "d", 4, ["B-2", "7", "9"]), ("p", "e", 1, ["C-3", "1", "2"])], "provider string, doc_id string, row_no int, cells array<string>")
    docs = spark.createDataFrame([("p", "d", "SKU A1 5,000 4.50 usd", 2.0), ("p", "e", "", 1.0), ("p", "f", "", 4.0)], "provider string, doc_id string, text string, seconds double")
    wanted = spark.createDataFrame([("d", 0, "A-1", "5000", "4.50", "USD"), ("d", 1, "B-2", "7", "9", "USD"), ("e", 0, "C-3", "1", "8", None), ("f", 0, "Z-9", "1", "1.5", None)], "doc_id string, line_no int, supplier_sku string, quantity string, unit_price string, currency string")
    r = evaluate.parser_matrix(rows, docs, wanted).first().asDict()
    assert r["documents"] == 3 and r["table_detection"] == 66.667 and r["lines_recovered"] == 75.0 and r["associated"] == 50.0 and r["missing_rows"] == 25.0 and r["duplicate_rows"] == 25.0
    assert r["row_count_accuracy"] == 66.667 and r["header_detection"] == 20.0 and r["reading_order"] == 66.667 and r["sku_kept"] == 25.0 and r["quantity_kept"] == 25.0 and r["price_kept"] == 25.0 and r["decimal_kept"] == 75.0
    assert r["median_seconds"] == 2.0 and r["p95_seconds"] == 4.0 and r["currency_kept"] == 100.0


def test_mail_report(spark):
    fields = {f: None for f in evaluate.MAIL_FIELDS.values()}
    case = {"case_id": "1", "supplier_name": "A", "supplier_method": "KNOWN_ALIAS", "thread": "t", "conflict": False, "quote_expected": True, "injected_price": "1", **fields, "unit_price": "4.50", "quantity": "5", "currency": "USD", "tags": ["x", "y"]}
    found = {"case_id": "1", "sender_role": "SUPPLIER", "supplier_name": "B", "supplier_method": "KNOWN_ALIAS", "thread": "t", "conflict": False, "has_quote": True, "accepted": 3, "evidenced": 2, "unsupported": 0, "failed": False, **fields, "unit_price": "4.5", "quantity": "6", "currency": "usd", "tax": "0"}
    kinds = {"conflict": "boolean", "quote_expected": "boolean", "has_quote": "boolean", "failed": "boolean", "accepted": "int", "evidenced": "int", "unsupported": "int", "tags": "array<string>"}
    table = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {kinds.get(k, 'string')}" for k in rows[0]))
    cases = table([case, case | {"case_id": "2", "tags": ["x"]}])
    got = {r["metric"]: (r["correct"], r["total"]) for r in evaluate.email_report(evaluate.email_observations(cases, table([found]))).collect()}
    assert got["alias"] == (0, 1) and got["unit_price"] == (1, 1) and got["quantity"] == (0, 1) and got["critical"] == (2, 3) and got["tax"] == (0, 1) and got["no_prompt_injection"] == (1, 1)
    assert got["processing_success"] == (1, 2) and got["accepted_evidence"] == (2, 3) and got["no_missing_hallucination"] == (1, 1) and "domain" not in got
    assert {tuple(r) for r in evaluate.tag_counts(cases).collect()} == {("x", 2), ("y", 1)}


def test_parser_matrix_reads_every_order(spark, sf_dir, monkeypatch):
    from bidlake.plans import adapters, decisions

    monkeypatch.setattr(decisions.evaluate, "parser_matrix", lambda rows, text, line: line)
    want = adapters.base(spark, sf_dir)
    got = decisions.parser_matrix(spark, sf_dir)
    assert got.count() == want.count() and got.select("doc_id").distinct().count() == want.select("po_number").distinct().count()
