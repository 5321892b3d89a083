"""Totals, price history, tiers and delivery performance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.numbers import money

ORG = "organization_id"
PRICE_KEY = [ORG, "item_id", "currency", "uom"]


def line_total(quantity: Column, unit_price: Column) -> Column:
    """Rounded amount of a line; null if a factor is."""
    return money(quantity * unit_price)


def quote_totals(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """``organization_id, quote_id, line_count, subtotal, total``: a subtotal is null if any line's amount is, 0.00
    without lines; a total also needs shipping and tax."""
    amounts = lines.select(ORG, "quote_id", line_total(F.col("quantity"), F.col("unit_price")).alias("amount"))
    sums = amounts.groupBy(ORG, "quote_id").agg(
        F.count("*").alias("n"), F.count("amount").alias("known"), F.sum("amount").alias("amount")
    )
    joined = quotes.join(sums, [ORG, "quote_id"], "left")
    subtotal = F.when(F.coalesce("known", F.lit(0)) == F.coalesce("n", F.lit(0)), F.coalesce("amount", F.lit(0)).cast("decimal(18,2)"))
    return joined.withColumn("subtotal", subtotal).select(
        ORG,
        "quote_id",
        F.coalesce("n", F.lit(0)).alias("line_count"),
        "subtotal",
        money(F.col("subtotal") + F.col("shipping_cost") + F.col("tax")).alias("total"),
    )


def price_history(probes: DataFrame, history: DataFrame, days: tuple[int, int] = (183, 92), by: tuple[str, ...] = ()) -> DataFrame:
    """What was paid before: for ``probes(probe_id, organization_id, item_id, currency, uom, as_of)`` the sums and counts
    of history prices in the ``days`` up to ``as_of``, and the last purchase (of equal dates the greatest id).

    History is first summed by day, so a hot item is as many rows as it has days. Each probe then reads running sums at
    ``as_of`` and just before each window's start; a window's sum is a difference of two. One pass by key, one by
    probe, and no row per pair of probe and purchase. ``by`` adds keys, such as the supplier.
    """
    key = [*PRICE_KEY, *by]
    priced = history.select(*key, "date", "purchase_id", "unit_price").where(F.col("unit_price").isNotNull())
    daily = priced.groupBy(*key, "date").agg(
        F.sum("unit_price").alias("s"), F.count("*").alias("n"), F.max(F.struct("purchase_id", "unit_price")).alias("last")
    )
    daily = daily.select(*key, "date", F.lit(0).alias("kind"), "s", "n", F.struct("date", F.col("last.unit_price").alias("price")).alias("last"), F.lit(None).cast("string").alias("probe_id"))
    starts = F.array(F.struct(F.lit(1).alias("kind"), F.col("as_of").alias("date")), *(F.struct(F.lit(i + 2).alias("kind"), F.date_sub("as_of", n + 1).alias("date")) for i, n in enumerate(days)))
    asked = probes.select(*key, "probe_id", F.explode(starts).alias("x")).select(
        *key, "x.date", "x.kind", F.lit(None).cast(daily.schema["s"].dataType).alias("s"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(daily.schema["last"].dataType).alias("last"), F.col("probe_id").cast("string").alias("probe_id")
    )
    w = Window.partitionBy(*key).orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = daily.unionByName(asked).select("probe_id", "kind", F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"), F.last("last", True).over(w).alias("last")).where("probe_id is not null")
    at = lambda c, k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    price = "decimal(28,6)"
    return run.groupBy("probe_id").agg(
        *((at("s", 1) - at("s", i + 2)).cast(price).alias(f"sum_{n}") for i, n in enumerate(days)),
        *((at("n", 1) - at("n", i + 2)).alias(f"n_{n}") for i, n in enumerate(days)),
        F.max(F.when(F.col("kind") == 1, F.col("last.date"))).alias("last_date"),
        F.max(F.when(F.col("kind") == 1, F.struct("last.date", "last.price"))).getField("price").alias("last_price"),
    )


def increased(price: Column, total: Column, n: Column, threshold: Column) -> Column:
    """Whether a price is at least ``threshold`` over the average ``total / n``, tested on exact products."""
    base, n = total.cast("decimal(24,6)"), n.cast("decimal(12,0)")
    return F.coalesce((total != 0) & (price.cast("decimal(18,6)") * n - base >= threshold.cast("decimal(8,4)") * base), F.lit(False))


def rolling_mean(history: DataFrame, days: int = 183) -> DataFrame:
    """Sum and count of the prices in the ``days`` up to each purchase, over purchases of one item, currency and unit."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*PRICE_KEY).orderBy(day).rangeBetween(-days, 0)
    return history.withColumn("sum_price", F.sum("unit_price").over(w)).withColumn("n_price", F.count("unit_price").over(w))


def last_purchase(history: DataFrame, as_of: Column) -> DataFrame:
    """The last purchase of each item, currency and unit on or before a date, ties by id."""
    last = F.max_by(F.struct("date", "purchase_id", "supplier_id", "unit_price"), F.struct("date", "purchase_id"))
    return history.where(F.col("date") <= as_of).groupBy(*PRICE_KEY).agg(last.alias("p")).select(*PRICE_KEY, "p.*")


def on_time(history: DataFrame, *by: str) -> DataFrame:
    """``orders, on_time`` over delivered purchases."""
    return history.where("actual_delivery is not null").groupBy(*by).agg(F.count("*").alias("orders"), F.count_if(F.col("actual_delivery") <= F.col("expected_delivery")).alias("on_time"))


def supplier_spend(history: DataFrame) -> DataFrame:
    """Of each supplier and currency: spend (sum of rounded amounts), orders, lead days and on-time deliveries."""
    return history.groupBy(ORG, "supplier_id", "currency").agg(
        F.sum(line_total(F.col("quantity"), F.col("unit_price"))).cast("decimal(28,2)").alias("spend"),
        F.count("*").alias("orders"),
        F.sum("lead_time_days").alias("lead_days"),
        F.count("lead_time_days").alias("leads"),
        F.count_if(F.col("actual_delivery") <= F.col("expected_delivery")).alias("on_time"),
    )


def applicable_tiers(tiers: Column, quantity: Column) -> Column:
    """The tiers ``array<struct<minimum, maximum, unit_price>>`` whose range holds a quantity."""
    return F.filter(tiers, lambda t: (t["minimum"] <= quantity) & (t["maximum"].isNull() | (quantity <= t["maximum"])))


def tier_mismatch(tiers: Column, quantity: Column, unit_price: Column) -> Column:
    """Whether there are tiers but not exactly one of them at that price."""
    own = applicable_tiers(tiers, quantity)
    fits = (F.size(own) == 1) & F.coalesce(F.try_element_at(own, F.lit(1))["unit_price"] == unit_price, F.lit(False))
    return F.coalesce((F.size(tiers) > 0) & quantity.isNotNull() & ~fits, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(Column.__and__, (F.coalesce(c, F.lit(False)) for c in conditions))
