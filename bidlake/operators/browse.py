"""Search, paging, heads and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 250


def search(df: DataFrame, cols: list[str], term: str) -> DataFrame:
    """Rows with the term in any of the columns, whatever its case; % and _ are wildcards."""
    return df.where(reduce(Column.__or__, (F.coalesce(F.col(c).cast("string").ilike(f"%{term}%"), F.lit(False)) for c in cols)))


def search_related(df: DataFrame, cols: list[str], term: str, related: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    """Rows with the term in their own columns or in those of a related table, given as (table, columns, key)."""
    hit = [c for c in cols]
    out = df.withColumn("_hit", reduce(Column.__or__, (F.coalesce(F.col(c).cast("string").ilike(f"%{term}%"), F.lit(False)) for c in hit), F.lit(False)))
    for i, (table, fields, key) in enumerate(related):
        keys = search(table, fields, term).select(key).distinct().withColumn(f"_r{i}", F.lit(True))
        out = out.join(keys, key, "left").withColumn("_hit", F.col("_hit") | F.coalesce(f"_r{i}", F.lit(False))).drop(f"_r{i}")
    return out.where("_hit").drop("_hit")


def filtered(df: DataFrame, **equal: object) -> DataFrame:
    """Rows equal to the given values, for columns that exist and values that are not None."""
    for c, v in equal.items():
        if v is not None and c in df.columns:
            df = df.where(F.col(c) == v)
    return df


def page(df: DataFrame, sort: str | None, allowed: list[str], id_col: str, number: int = 1, size: int = 50, descending: bool = False) -> DataFrame:
    """One page in the order of an allowed column, then id. Spark keeps only the rows up to the page's end."""
    c = F.col(sort) if sort in allowed else F.col(id_col)
    number, size = max(1, number), min(max(1, size), MAX_PAGE)
    return df.orderBy(c.desc() if descending else c.asc(), id_col).offset((number - 1) * size).limit(size)


def after(df: DataFrame, sort: str, id_col: str, last: tuple | None, size: int = 50) -> DataFrame:
    """The next page by key: rows after the last one seen, without counting those before."""
    if last is not None:
        v, i = last
        df = df.where((F.col(sort) > v) | ((F.col(sort) == v) & (F.col(id_col) > i)))
    return df.orderBy(sort, id_col).limit(min(size, MAX_PAGE))


def newest(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in an order; Spark limits groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def redacted(df: DataFrame, hidden: tuple[str, ...] = ("raw_text", "storage_key")) -> DataFrame:
    """Without hidden columns, and with decimals as text."""
    kept = [c for c in df.columns if c not in hidden]
    kinds = dict(df.dtypes)
    return df.select(*(F.col(c).cast("string").alias(c) if kinds[c].startswith("decimal") else F.col(c) for c in kept))


def with_defaults(df: DataFrame, other: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Columns of a dimension, with defaults where it has no row or no value."""
    joined = df.join(other.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def retryable(rows: DataFrame) -> DataFrame:
    """Add ``status, refused``: failed and review rows without a quote are received again, others say why not."""
    again = F.col("status").isin("FAILED", "NEEDS_REVIEW", "Error") & F.col("quote_id").isNull()
    why = F.when(again, None).when(F.col("quote_id").isNotNull(), "HAS_QUOTE").when(F.col("status") == "PROCESSING", "PROCESSING").otherwise("NOT_FAILED")
    return rows.withColumn("refused", why).withColumn("status", F.when(again, "RECEIVED").otherwise(F.col("status")))


def supplier_profile(suppliers: DataFrame, spend: DataFrame, history: DataFrame, n: int = 30) -> DataFrame:
    """A row for each supplier: spend by currency and its newest purchases, at most ``n``."""
    money = spend.groupBy("organization_id", "supplier_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("currency", "spend")))).alias("spend"), F.sum("orders").alias("orders"), F.sum("on_time").alias("on_time")
    )
    rows = newest(history, ["organization_id", "supplier_id"], [F.col("date").desc(), F.col("purchase_id").desc()], n)
    recent = rows.groupBy("organization_id", "supplier_id").agg(F.sort_array(F.collect_list(F.struct("date", "purchase_id", "item_id", "unit_price")), asc=False).alias("recent"))
    return suppliers.join(money, ["organization_id", "supplier_id"], "left").join(recent, ["organization_id", "supplier_id"], "left")
