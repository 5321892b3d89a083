"""Readers: tenant tables, purchase-history CSV, delimited documents, word boxes, structure JSON, labels, manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidlake.functions.text import norm_key

ORG = "organization_id"
HISTORY = "po_number string, date date, supplier string, sku string, quantity decimal(18,4), unit_price decimal(18,6), currency string, uom string, lead_time_days int, expected_delivery date, actual_delivery date, _corrupt string"


def tenant_table(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    """A table's rows of one tenant; with ``partitionBy(organization_id)`` only its folders are read."""
    return spark.read.parquet(path).where(F.col(ORG) == tenant)


def history_csv(spark: SparkSession, path: str, tenant: str, suppliers: DataFrame, items: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejects)`` of purchase-history files: every row with the reasons against it. Suppliers and items must be known, the unit
    be the item's, and (order, item) new to the table and to the files. Import only if there are no rejects."""
    rows = spark.read.csv(path, schema=HISTORY, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").withColumn(ORG, F.lit(tenant))
    s = suppliers.select(ORG, "supplier_id", norm_key(F.col("name")).alias("_s"))
    i = items.select(ORG, "item_id", F.col("uom").alias("_uom"), norm_key(F.col("sku")).alias("_i"))
    r = rows.withColumns({"_s": norm_key(F.col("supplier")), "_i": norm_key(F.col("sku"))}).join(s, [ORG, "_s"], "left").join(i, [ORG, "_i"], "left")
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy(ORG, "po_number", "item_id")))
    old = known.select(ORG, "po_number", "item_id").distinct().withColumn("_old", F.lit(True))
    r = r.join(old, [ORG, "po_number", "item_id"], "left")
    bad = lambda when, code: F.when(F.coalesce(when, F.lit(False)), code)
    why = F.array_compact(F.array(
        bad(F.col("_corrupt").isNotNull(), "UNREADABLE"), bad(F.col("supplier_id").isNull(), "UNKNOWN_SUPPLIER"), bad(F.col("item_id").isNull(), "UNKNOWN_SKU"), bad(F.col("uom") != F.col("_uom"), "UOM_DIFFERS"),
        bad((F.col("_n") > 1) & F.col("item_id").isNotNull(), "REPEATED_IN_FILE"), bad(F.col("_old"), "ALREADY_IMPORTED"),
        bad(F.col("quantity").isNull() | (F.col("quantity") <= 0), "BAD_QUANTITY"), bad(F.col("unit_price").isNull() | (F.col("unit_price") < 0), "BAD_PRICE"), bad(F.col("date").isNull(), "BAD_DATE"),
    ))
    r = r.withColumn("reasons", why).drop("_s", "_i", "_uom", "_n", "_old")
    return r.where(F.size("reasons") == 0).drop("reasons", "_corrupt"), r.where(F.size("reasons") > 0)


def delimited_cells(files: DataFrame) -> DataFrame:
    """``path, row, column, cell, value`` of delimited documents ``files(path, content)``: physical rows from 1, quoted line breaks kept,
    trailing empty cells dropped; ``cell`` is like ``CSV!A2``. Files that are no UTF-8 give one row with ``error``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    reader = csv.reader(io.StringIO(bytes(content).decode("utf-8-sig"), newline=""))
                    for n, row in enumerate(reader, 1):
                        while row and not row[-1].strip():
                            row.pop()
                        out += [(path, n, i, v, None) for i, v in enumerate(row)]
                except (UnicodeDecodeError, csv.Error) as e:
                    out.append((path, None, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["path", "row", "column", "value", "error"]).astype({"row": "Int32", "column": "Int32"})

    cells = files.select("path", "content").mapInPandas(read, "path string, row int, column int, value string, error string")
    i = F.col("column")
    letter = F.when(i < 26, F.char(i + 65)).otherwise(F.concat(F.char(F.floor(i / 26) + 64), F.char(i % 26 + 65)))
    return cells.withColumn("cell", F.when(i.isNotNull(), F.concat(F.lit("CSV!"), letter, F.col("row").cast("string"))))


def word_rows(words: DataFrame) -> DataFrame:
    """Physical lines of ``words(doc_id, page, text, x0, top, x1, bottom, line_key)``: words of one key, or of one height band where there is
    none, from left to right, with the box around them."""
    line = F.coalesce(F.col("line_key"), F.concat(F.lit("y"), F.round(F.col("top") / 4).cast("int").cast("string")))
    w = F.array_sort(F.collect_list(F.struct("x0", "text", "x1")))
    rows = words.withColumn("line", line).groupBy("doc_id", "page", "line").agg(w.alias("words"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    return rows.withColumn("raw", F.array_join(F.transform("words", lambda x: x["text"]), " ")).withColumn("bbox", F.array("x0", "top", "x1", "bottom")).drop("x0", "x1", "bottom")


STRUCTURE = "doc_id string, tables array<struct<rows:array<array<string>>>>, pages array<struct<page:int,tables:array<struct<rows:array<array<string>>>>>>"


def structure_cells(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, page, table, row, column, value, header`` of structure files, whose tables stand in the document or in its pages; row 1 is the header."""
    docs = spark.read.schema(STRUCTURE).json(path, multiLine=True)
    of_pages = F.transform(F.coalesce("pages", F.array().cast("array<struct<page:int,tables:array<struct<rows:array<array<string>>>>>>")), lambda p: F.transform(p["tables"], lambda t: F.struct(p["page"].alias("page"), t["rows"].alias("rows"))))
    own = F.transform(F.coalesce("tables", F.array().cast("array<struct<rows:array<array<string>>>>")), lambda t: F.struct(F.lit(None).cast("int").alias("page"), t["rows"].alias("rows")))
    tables = docs.select("doc_id", F.posexplode(F.concat(own, F.flatten(of_pages))).alias("table", "t"))
    rows = tables.select("doc_id", "t.page", (F.col("table") + 1).alias("table"), F.col("t.rows")[0].alias("names"), F.posexplode("t.rows").alias("row", "cells"))
    cells = rows.select("doc_id", "page", "table", (F.col("row") + 1).alias("row"), "names", F.posexplode("cells").alias("column", "value"))
    return cells.withColumn("header", F.try_element_at("names", (F.col("column") + 1).cast("int"))).drop("names")


def labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ground-truth documents, one JSON file each, with their id from the file name."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.withColumn("doc_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def changed_documents(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents of the manifest ``(name, sha256)`` that are gone or whose content differs; a run needs that there are none."""
    now = files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("now"))
    return manifest.join(now, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).withColumn("problem", F.when(F.col("now").isNull(), "REMOVED").otherwise("CHANGED"))


def still_to_do(todo: DataFrame, done: DataFrame, key: str, versions: list[str]) -> DataFrame:
    """What a resumed run has left: keys not done, where rows of an unavailable model do not count as done. Mixed versions are an error."""
    if done.select(*versions).distinct().limit(2).count() > 1:
        raise ValueError(f"finished rows mix versions of {', '.join(versions)}")
    return todo.join(done.where(~F.col("error_type").eqNullSafe("MODEL_UNAVAILABLE")).select(key), key, "left_anti")


def file_gate(files: DataFrame, max_bytes: int = 15_000_000) -> DataFrame:
    """Add ``refused``: why a file is not taken (type unknown, content not of its type, empty, too large, text that is no UTF-8)."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 8))
    magic = F.create_map(*(F.lit(x) for x in ("pdf", "25504446", "png", "89504E470D0A1A0A", "jpg", "FFD8FF", "jpeg", "FFD8FF", "xlsx", "504B0304")))
    want = F.try_element_at(magic, ext)
    refused = (
        F.when(F.length("content") == 0, "EMPTY").when(F.length("content") > max_bytes, "TOO_LARGE").when(want.isNull() & ~ext.isin("csv", "txt", "json", "eml"), "UNKNOWN_TYPE")
        .when(want.isNotNull() & ~head.startswith(want), "CONTENT_DIFFERS").when(want.isNull() & ~F.is_valid_utf8(F.col("content").cast("string")), "NOT_UTF8")
    )
    return files.withColumn("refused", refused)


def extract(docs: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str) -> DataFrame:
    """Run a user's extractor over batches of documents. If it fails on a batch it is tried document by document, and what fails then is a
    row with ``error_type``; the job goes on. ``schema`` describes what ``fn`` returns, with the key."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield fn(b).assign(error_type=None)
            except Exception:
                for i in range(len(b)):
                    one = b.iloc[i : i + 1]
                    try:
                        yield fn(one).assign(error_type=None)
                    except Exception as e:
                        yield pd.DataFrame([{n: None for n in names} | {key: one[key].iloc[0], "error_type": type(e).__name__}])

    return docs.mapInPandas(run, f"{schema}, error_type string")


def violations(rules: dict[str, Column]) -> Column:
    """The codes of the rules that a row breaks."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in rules.items())))


def quote_line_rules() -> dict[str, Column]:
    """Ranges and scales of quote lines."""
    c = F.col
    return {
        "PRICE_RANGE": ~c("unit_price").between(0, 100_000_000_000),
        "QUANTITY_RANGE": (c("quantity") <= 0) | (c("quantity") > 1_000_000_000),
        "QUANTITY_SCALE": c("quantity") != F.round("quantity", 4),
        "LEAD_TIME_RANGE": ~c("lead_time_days").between(0, 3650),
        "CONFIDENCE_RANGE": ~c("confidence").between(0, 1),
        "CURRENCY_CODE": ~c("currency").rlike("^[A-Z]{3}$"),
    }
