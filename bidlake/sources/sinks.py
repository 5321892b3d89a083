"""Writers: append-only audit rows, immutable snapshots, metrics, all-or-nothing imports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where it is unset, local mode takes a temporary one; on a cluster
    that is an error, as executors would write to folders of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new table in the shared folder and read from there: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/bidlake-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds anything but marks of finished jobs."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(p))


def put_epoch(rows: DataFrame, epoch: int, path: str, *partitions: str) -> None:
    """Write the rows of one micro-batch to partitions of its number. A batch that is run again replaces what it wrote before, so a restart
    in the middle of one leaves nothing twice."""
    out = rows.withColumn("epoch", F.lit(epoch).cast("long"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", *partitions).parquet(path)


def audit_rows(changes: DataFrame, action: str, entity: str, entity_id: str, old: Column, new: Column) -> DataFrame:
    """Audit rows with old and new values as JSON; the id is a hash of the content, so that writing again can be told."""
    rows = changes.select("organization_id", F.lit(action).alias("action"), F.lit(entity).alias("entity"), F.col(entity_id).cast("string").alias("entity_id"), F.to_json(old).alias("old_values"), F.to_json(new).alias("new_values"))
    return rows.withColumn("audit_id", F.sha2(F.to_json(F.struct(*rows.columns)), 256))


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the table does not have yet."""
    spark = rows.sparkSession
    if table_exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.dropDuplicates([key]).write.mode("append").parquet(path)


def snapshots(df: DataFrame, *ids: str) -> DataFrame:
    """Each row as JSON under an id of its content."""
    return df.select(*ids, F.to_json(F.struct(*sorted(df.columns))).alias("snapshot")).withColumn("snapshot_id", F.sha2("snapshot", 256))


def import_all(accepted: DataFrame, rejects: DataFrame, path: str) -> bool:
    """Append the accepted rows if none were rejected."""
    if not rejects.isEmpty():
        return False
    accepted.write.mode("append").partitionBy("organization_id").parquet(path)
    return True


def metrics(summary: DataFrame, fields: DataFrame, folder: str) -> None:
    """A run's summary as JSON and its field scores as CSV with a header."""
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    fields.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/fields")
