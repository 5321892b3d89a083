"""Round trips of readers and writers."""

from decimal import Decimal as D

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bidlake.operators import mail
from bidlake.sources import files, sinks

ORG = "organization_id"


def test_history_import(spark, tmp_path):
    head = "po_number,date,supplier,sku,quantity,unit_price,currency,uom,lead_time_days,expected_delivery,actual_delivery\n"
    good = "1,2026-01-01,Acme,A-1,5,2.5,USD,EA,3,2026-01-09,\n"
    (tmp_path / "h.csv").write_text(head + good + "2,2026-01-01,Nobody,A-1,5,2.5,USD,EA,3,2026-01-09,\n3,2026-01-01,acme,a1,0,2.5,USD,KG,3,2026-01-09,\n1,2026-01-01,Acme,A-1,5,2.5,USD,EA,3,2026-01-09,\n9,2026-01-01,Acme,A-1,5,2.5,USD,EA,3,2026-01-09,\n")
    s = spark.createDataFrame([("o", 1, "ACME")], f"{ORG} string, supplier_id int, name string")
    i = spark.createDataFrame([("o", 7, "A-1", "EA")], f"{ORG} string, item_id int, sku string, uom string")
    known = spark.createDataFrame([("o", "9", 7)], f"{ORG} string, po_number string, item_id int")
    ok, bad = files.history_csv(spark, str(tmp_path / "h.csv"), "o", s, i, known)
    assert ok.count() == 0
    assert sorted((r["po_number"], r["reasons"]) for r in bad.collect()) == [("1", ["REPEATED_IN_FILE"]), ("1", ["REPEATED_IN_FILE"]), ("2", ["UNKNOWN_SUPPLIER"]), ("3", ["UOM_DIFFERS", "BAD_QUANTITY"]), ("9", ["ALREADY_IMPORTED"])]
    assert not sinks.import_all(ok, bad, str(tmp_path / "t"))
    (tmp_path / "g.csv").write_text(head + good)
    ok, bad = files.history_csv(spark, str(tmp_path / "g.csv"), "o", s, i, known)
    assert sinks.import_all(ok, bad, str(tmp_path / "t")) and files.tenant_table(spark, str(tmp_path / "t"), "o").first()["unit_price"] == D("2.5")


def test_cells_and_gate(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'SKU,Qty,,\n"A\n1",5\n')
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "d.xyz").write_bytes(b"?")
    f = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    cells = files.delimited_cells(f.where("path like '%.csv'")).collect()
    assert {(r["cell"], r["value"]) for r in cells if r["cell"]} == {("CSV!A1", "SKU"), ("CSV!B1", "Qty"), ("CSV!A2", "A\n1"), ("CSV!B2", "5")} and sum(r["error"] is not None for r in cells) == 1
    got = {r["path"][-5:]: r["refused"] for r in files.file_gate(f).collect()}
    assert got == {"a.csv": None, "b.csv": "NOT_UTF8", "c.pdf": "CONTENT_DIFFERS", "d.xyz": "UNKNOWN_TYPE"}
    manifest = f.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256")).unionByName(spark.createDataFrame([("gone", "x")], "name string, sha256 string"))
    assert [r["problem"] for r in files.changed_documents(f, manifest).collect()] == ["REMOVED"]


def test_structures_and_words(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"doc_id":"d","pages":[{"page":2,"tables":[{"rows":[["SKU","Qty"],["A","5"]]}]}]}')
    got = {(r["page"], r["row"], r["header"], r["value"]) for r in files.structure_cells(spark, str(tmp_path / "s.json")).collect()}
    assert got == {(2, 1, "SKU", "SKU"), (2, 1, "Qty", "Qty"), (2, 2, "SKU", "A"), (2, 2, "Qty", "5")}
    w = spark.createDataFrame([("d", 1, "b", 9.0, 1.0, 12.0, 2.0, None), ("d", 1, "a", 1.0, 1.2, 4.0, 2.1, None), ("d", 1, "z", 1.0, 50.0, 2.0, 51.0, "k")], "doc_id string, page int, text string, x0 double, top double, x1 double, bottom double, line_key string")
    assert {r["raw"] for r in files.word_rows(w).collect()} == {"a b", "z"}


def test_extractor_and_resume(spark):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(4)], "doc_id long, text string")

    def fn(b):
        if (b["doc_id"] == 2).any():
            raise ValueError("no")
        return pd.DataFrame({"doc_id": b["doc_id"], "n": b["text"].str.len()})

    got = {r["doc_id"]: (r["n"], r["error_type"]) for r in files.extract(docs.coalesce(1), fn, "doc_id long, n long", "doc_id").collect()}
    assert got == {0: (0, None), 1: (1, None), 2: (None, "ValueError"), 3: (3, None)}
    done = spark.createDataFrame([(1, "m", None), (3, "m", "MODEL_UNAVAILABLE")], "doc_id long, model string, error_type string")
    assert {r["doc_id"] for r in files.still_to_do(docs, done, "doc_id", ["model"]).collect()} == {0, 2, 3}
    with pytest.raises(ValueError):
        files.still_to_do(docs, done.withColumn("model", F.col("doc_id")), "doc_id", ["model"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("o", 1, "a", "b")], f"{ORG} string, id int, old string, new string")
    rows = sinks.audit_rows(df, "CHANGE", "quote", "id", F.struct("old"), F.struct("new"))
    for _ in range(2):
        sinks.append_new(rows, str(tmp_path / "audit"), "audit_id")
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1
    assert sinks.snapshots(df, "id").first()["snapshot"].startswith("{")
    sinks.metrics(df, df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m/fields")).count() == 1


def test_messages(spark):
    eml = b"From: Ann <Ann@S.example>\r\nTo: b@x\r\nSubject: Quote\r\nMessage-ID: <1@s>\r\nDate: Wed, 09 Sep 2026 10:00:00 +0200\r\n\r\nUnit price: 4.50\r\n"
    got = {r["path"]: r for r in mail.parse_messages(spark.createDataFrame([("a", eml), ("b", b"")], "path string, content binary")).collect()}
    assert got["a"]["sender_email"] == "ann@s.example" and got["a"]["message_id"] == "<1@s>" and "4.50" in got["a"]["body"] and got["a"]["error"] is None and got["b"]["error"]
    assert got["a"]["sent_at"].hour == 8
