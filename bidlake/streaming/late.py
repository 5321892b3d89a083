"""Rows behind the watermark: kept apart, then merged by working out their keys again.

Each micro-batch writes its rows to tables by its number, late ones apart, and then the results of the keys that it touched, from all of
their rows so far. A batch that is run again replaces its own partitions, so results are those of one batch over all rows, however late
and however often they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidlake.sources.sinks import put_epoch, table_exists

BUCKETS = 64


def recomputed(df: DataFrame, key: str, at: str, late_seconds: int, recompute: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Run a stream's new input: ``folder/events`` gets its rows (``late`` where they lie ``late_seconds`` or more behind the latest time of the batches
    before), ``folder/results`` the rows of ``recompute`` for the keys that they touch.

    Rows of a null time are never late. Rows lie in ``buckets`` by key; only buckets of touched keys are read again."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark, events, marks = batch.sparkSession, f"{folder}/events", f"{folder}/marks"
        high = spark.read.parquet(marks).where(F.col("epoch") < epoch).agg(F.max("high")).first()[0] if table_exists(spark, marks) else None
        bound = F.lit(high).cast("timestamp") - F.make_dt_interval(secs=F.lit(late_seconds))
        rows = batch.withColumns({"late": F.coalesce(F.col(at) <= bound, F.lit(False)), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
        put_epoch(rows, epoch, events, "late", "bucket")
        if not table_exists(spark, f"{events}/epoch={epoch}"):
            return
        so_far = spark.read.parquet(events).where(F.col("epoch") <= epoch)
        own = so_far.where(F.col("epoch") == epoch)
        touched = [r[0] for r in own.select("bucket").distinct().collect()]  # at most ``buckets``
        keys = own.select(key).distinct()
        known = so_far.where(F.col("bucket").isin(touched)).join(keys, key, "left_semi").select(*batch.columns)
        put_epoch(recompute(known), epoch, f"{folder}/results")
        put_epoch(own.agg(F.max(at).alias("high")), epoch, marks)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that came behind the watermark."""
    return spark.read.parquet(f"{folder}/events").where(F.col("late").cast("boolean")).drop("late", "bucket")


def current(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Each key's rows of the last batch that touched it."""
    results = spark.read.parquet(f"{folder}/results")
    last = results.groupBy(key).agg(F.max("epoch").alias("epoch"))
    return results.join(last, [key, "epoch"], "left_semi").drop("epoch")
