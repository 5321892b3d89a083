"""The driver tables read as procurement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2002-06-01"
TENANT = "org-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit_price():
    """Price per unit with 6 decimals, half up on whole cents and units."""
    cents, units = "cast(round(l_extendedprice * 100) AS bigint)", "cast(l_quantity AS bigint)"
    micros = F.expr(f"({cents} * 20000 + {units}) div ({units} * 2)").cast("decimal(18,0)")
    return (micros * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order, part and supplier."""
    line, order, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier"))
    joined = line.join(order, line["l_orderkey"] == order["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    date, shipped = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    return joined.select(
        F.lit(TENANT).alias("organization_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("purchase_id"),
        F.col("l_orderkey").alias("po_number"),
        F.col("l_linenumber").alias("line_no"),
        date.alias("date"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("decimal(18,4)").alias("quantity"),
        _unit_price().alias("unit_price"),
        F.when(F.col("s_nationkey") % 3 == 1, "EUR").otherwise("USD").alias("currency"),
        F.when(F.col("p_size") % 2 == 0, "EA").otherwise("BOX").alias("uom"),
        F.date_add(date, 30).alias("expected_delivery"),
        F.when(shipped >= date, shipped).alias("actual_delivery"),
        (F.col("l_linenumber") * 7).alias("lead_time_days"),
        "l_linestatus", "l_returnflag", "l_discount", "l_tax", "l_extendedprice", "o_orderpriority",
    )


def history(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return (rows or base(spark, sf_dir)).where("l_linestatus = 'F'")


def quote_rows(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Quotes of one line each."""
    b = (rows or base(spark, sf_dir)).where("l_linestatus = 'O' and date >= date'2000-01-01'")
    stated = F.when((F.col("l_returnflag") == "R") & (F.col("line_no") == 5), F.col("l_extendedprice").cast("decimal(18,4)"))
    return b.select(
        "organization_id",
        F.col("purchase_id").alias("quote_id"),
        F.col("item_id").alias("rfq_id"),
        "item_id", "supplier_id", "supplier_name", "line_no", "unit_price", "currency", "uom", "lead_time_days",
        (F.col("po_number") % 3).cast("string").alias("quote_number"),
        F.col("date").alias("quote_date"),
        F.date_add("date", 730).alias("expiration_date"),
        F.when(F.col("line_no") == 7, F.col("quantity")).otherwise(F.lit(25).cast("decimal(18,4)")).alias("quantity"),
        (F.col("line_no") * 5).cast("decimal(18,4)").alias("moq"),
        F.when(~((F.col("l_returnflag") == "N") & (F.col("line_no") == 1)), (F.col("l_tax") * 1000).cast("decimal(18,4)")).alias("shipping_cost"),
        F.lit(0).cast("decimal(18,4)").alias("tax"),
        F.when(F.col("l_discount") >= 0.09, F.lit("0.7")).otherwise("0.95").cast("decimal(5,4)").alias("confidence"),
        stated.alias("stated_line_total"),
    )


def quotes(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    none = F.lit(None).cast("decimal(18,4)")
    q = quote_rows(spark, sf_dir, rows)
    return q.select(
        "organization_id", "quote_id", "rfq_id", "supplier_id", "supplier_name", "quote_number", "quote_date", "expiration_date", "currency", "shipping_cost", "tax", "confidence",
        none.alias("stated_subtotal"), none.alias("stated_total"), F.lit("Needs Review").alias("review_status"), F.col("quote_date").cast("timestamp").alias("created_at"),
    )


TIER = "array<struct<minimum:decimal(18,4),maximum:decimal(18,4),unit_price:decimal(18,6)>>"
EVIDENCE = "map<string,struct<source_text:string,confidence:decimal(5,4)>>"


def quote_lines(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return quote_rows(spark, sf_dir, rows).select(
        "organization_id", "quote_id", "line_no", "item_id", F.col("item_id").cast("string").alias("supplier_sku"), "quantity", "uom", "unit_price", "moq", "lead_time_days",
        F.lit(None).cast("date").alias("delivery_date"), "stated_line_total", "confidence", F.lit(None).cast(TIER).alias("price_tiers"), F.lit(None).cast(EVIDENCE).alias("source_references"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit(TENANT).alias("organization_id"), F.col("p_partkey").alias("item_id"), F.concat(F.lit("P-"), F.col("p_partkey")).alias("sku"), F.concat_ws(" ", "p_name", "p_type").alias("description"),
        F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), F.col("p_partkey")).alias("manufacturer_part_number"), F.when(F.col("p_size") % 2 == 0, "EA").otherwise("BOX").alias("uom"),
    )


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.lit(TENANT).alias("organization_id"), F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), F.col("s_suppkey"), F.lit(" Ltd"))).alias("aliases"),
        F.concat(F.lit("s"), F.col("s_suppkey") % 400, F.lit(".example.com")).alias("email_domain"),
    )


def rfqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit(TENANT).alias("organization_id"), F.col("p_partkey").alias("rfq_id"), F.concat(F.lit("RFQ-"), F.col("p_partkey") + 1000).alias("number"), F.lit("USD").alias("currency"),
        F.date_add(F.lit(AS_OF).cast("date"), 30).alias("required_delivery"), F.lit(5).alias("supplier_count"), F.lit(1).alias("revision"), F.lit("Open").alias("status"),
    )


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.lit(TENANT).alias("organization_id"), F.col("p_partkey").alias("requirement_id"), F.col("p_partkey").alias("rfq_id"), F.col("p_partkey").alias("item_id"), F.lit(25).cast("decimal(18,4)").alias("quantity"))


def settings(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT '{TENANT}' AS organization_id, 50 AS price_weight, 25 AS lead_time_weight, 15 AS reliability_weight, 10 AS fit_weight, cast(0.10 AS decimal(8,4)) AS anomaly_threshold")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents in order; every 40 lines are a page."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return d.withColumn("page", (F.floor(F.col("line_no") / 40) + 1).cast("int"))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads: users buy, assistants sell."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.select(F.lit(TENANT).alias("organization_id"), F.col("conv_id").alias("thread_id"), "turn", F.when(F.col("role") == "user", "BUYER").otherwise("SUPPLIER").alias("sender_role"), F.coalesce("text", F.lit("")).alias("body"))
