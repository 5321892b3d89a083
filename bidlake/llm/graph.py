"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph of ``edges(a, b)``, longs: rows ``(node, root)`` for each node that is not
    its component's smallest. Null ends and loops are ignored, repeated edges count once, no edges give no rows.

    Each round hangs every node's larger neighbours on its smallest one (large star), then its smaller ones (small
    star). Only per-node minima are aggregated and joined back, so a hub is a partial aggregate and a skew join,
    never one task's group; the rounds needed grow with the logarithm of the longest path.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = staged(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        e = staged(small, "edges")
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
