"""Tables from word boxes: header phrases, column bounds, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.operators.facts import canonical


def header_phrases(words: DataFrame) -> DataFrame:
    """Add ``field`` to ``words(doc_id, page, line, x0, x1, text)``: what the longest phrase of three, two or one words that starts here names, unless
    a longer phrase before covers the word."""
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x0")
    ahead = lambda n: F.concat_ws(" ", "text", *(F.lead("text", i).over(w) for i in range(1, n + 1)))
    r = words.withColumns({f"p{n + 1}": F.when(F.lead("text", n).over(w).isNotNull() if n else F.lit(True), canonical(ahead(n))) for n in (2, 1, 0)})
    r = r.withColumn("span", F.when(F.col("p3").isNotNull(), 3).when(F.col("p2").isNotNull(), 2).when(F.col("p1").isNotNull(), 1).otherwise(0))
    covered = (F.coalesce(F.lag("span", 1).over(w), F.lit(0)) > 1) | (F.coalesce(F.lag("span", 2).over(w), F.lit(0)) > 2)
    return r.withColumn("field", F.when(~covered, F.coalesce("p3", "p2", "p1"))).drop("p1", "p2", "p3", "span")


def column_bounds(headers: DataFrame, gap: float = 2.0) -> DataFrame:
    """Bounds of each named column: from its header to just before the next one's."""
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x0")
    h = headers.where("field is not null")
    return h.select("doc_id", "page", "field", F.col("x0").alias("left"), F.coalesce(F.lead("x0").over(w) - gap, F.lit(1e9)).alias("right"))


def cells(words: DataFrame, bounds: DataFrame) -> DataFrame:
    """Words by the column that holds their middle: ``doc_id, page, line, field, value``. A page has few columns, so the range is checked after an
    equi join on the page."""
    middle = (F.col("x0") + F.col("x1")) / 2
    own = words.join(bounds, ["doc_id", "page"]).where((middle >= F.col("left")) & (middle < F.col("right")))
    return own.groupBy("doc_id", "page", "line", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("value"))
