"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Row numbers up to which a list of them is broadcast (8 bytes each); beyond, Spark joins them.
MOST_SENT = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; where it is unset, a temporary one in
    local mode, which is that of tests. On a cluster a machine's own folder would lose what executors write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def staged(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back: lineage ends here and survives lost executors.
    Columns ``partitions`` become folders, so that reading one of their values reads its files only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/bidlake-{uuid.uuid4().hex}/{name}"
    df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs``, written once with a number ``row`` for each row, so that repeated rows and null ids can be told apart."""
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def one_of_each(rows: DataFrame, row: str, groups: DataFrame) -> DataFrame:
    """Of ``rows``, numbered by ``row``, one row of each group of ``groups(row, group)``, which has all rows: the one with the smallest id
    (null after all others), among equal ids that with the least hash of all columns. Rows alike in all columns are told apart
    by number. The number is dropped.

    Up to ``MOST_SENT`` numbers of rows that go are broadcast, so that the others stay where they are; beyond, Spark joins."""
    columns = [F.col(f"`{c}`") for c in rows.columns if c != row]
    (out,) = fresh(rows, "gone")
    several = groups.toDF("at", "group")
    several = several.join(several.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "group")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"), F.col("at").alias("chosen")).alias("rank")
    known = rows.select(F.col(row).alias("at"), "doc_id", F.xxhash64(*columns).alias("hash"))
    ranked = staged(several.join(known, "at").select("at", "group", rank), "ranked")
    best = ranked.groupBy("group").agg(F.min("rank").alias("best"))
    gone = staged(ranked.join(best, "group").where("at <> best.chosen").select(F.col("at").alias(out)), "gone")
    small = gone.count() <= MOST_SENT
    return rows.join(F.broadcast(gone) if small else gone, F.col(row) == F.col(out), "left_anti").select(*columns)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send whole texts to Python workers in batches of at most so many rows: what a worker and its JVM hold at once then
    follows from texts' lengths, not from Arrow's default of 10,000 rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def once(udf):
    """A UDF that a later filter on its result does not make Spark run a second time."""
    return udf.asNondeterministic()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
