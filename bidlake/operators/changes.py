"""Deduplication, change capture, revisions and threads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.sources.sinks import shared_table

ORG = "organization_id"


def mark_copies(df: DataFrame, key: list[Column], order: list[str], id_col: str) -> DataFrame:
    """Add ``duplicate_of``: the first row's id for later rows of an equal key; null for firsts and for null keys."""
    w = Window.partitionBy(*key).orderBy(*order)
    known = reduce(Column.__and__, (k.isNotNull() for k in key))
    return df.withColumn("duplicate_of", F.when(known & (F.row_number().over(w) > 1), F.first(id_col).over(w)))


def documents_once(docs: DataFrame) -> DataFrame:
    """Copies by content hash within a tenant; the first id stays."""
    hashed = docs.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    return mark_copies(hashed, [F.col(ORG), F.col("sha256")], ["doc_id"], "doc_id")


def emails_once(emails: DataFrame) -> DataFrame:
    """Copies by message id, else by content, sender and time where both of these are known."""
    fallback = F.when(F.col("sender_email").isNotNull() & F.col("sent_at").isNotNull(), F.concat_ws("\x1f", "content_hash", "sender_email", F.col("sent_at").cast("string")))
    key = F.coalesce(F.concat(F.lit("id:"), F.col("message_id")), F.concat(F.lit("content:"), fallback))
    return mark_copies(emails.withColumn("_key", key), [F.col(ORG), F.col("_key")], ["received_at", "email_id"], "email_id").drop("_key")


def attachments_once(attachments: DataFrame) -> DataFrame:
    """The first attachment of each content within a message."""
    w = Window.partitionBy(ORG, "email_id", "sha256").orderBy("ordinal")
    return attachments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def nth_copy(df: DataFrame, key: list[Column], order: list[str], name: str = "occurrence") -> DataFrame:
    """Number equal rows in order: 1 for the first, more for its copies, which are kept."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def field_changes(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows ``(*keys, field, old_value, new_value)`` for each field that differs, null-safe; rows of only one side count with nulls on the
    other."""

    def long(df: DataFrame, side: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(side)) for f in fields))
        return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")

    both = long(old, "old_value").join(long(new, "new_value"), [*keys, "field"], "full_outer")
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def correction_log(old: DataFrame, new: DataFrame, extractions: DataFrame, fields: list[str]) -> DataFrame:
    """Field changes of quotes with the versions of the extraction they correct and the value the model had given."""
    latest = extractions.groupBy(ORG, "document_id").agg(F.max_by(F.struct("extraction_id", "model", "prompt_version", "pipeline_version", "raw"), F.struct("created_at", "extraction_id")).alias("x"))
    of = old.select(ORG, "quote_id", "document_id")
    changed = field_changes(old, new, [ORG, "quote_id"], fields).join(of, [ORG, "quote_id"], "left").join(latest, [ORG, "document_id"], "left")
    value = F.from_json("x.raw", "map<string,string>")[F.col("field")]
    return changed.select(ORG, "quote_id", "field", "old_value", "new_value", "document_id", "x.extraction_id", "x.model", "x.prompt_version", "x.pipeline_version", value.alias("model_value"))


def not_exactly_once(expected: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing from ``given``, unexpected in it, or repeated."""
    a = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    b = given.groupBy(*keys).agg(F.count("*").alias("_n"))
    why = F.when(F.col("_n").isNull(), "MISSING").when(F.col("_e").isNull(), "UNEXPECTED").when(F.col("_n") > 1, "REPEATED")
    return a.join(b, keys, "full_outer").withColumn("problem", why).where("problem is not null").drop("_e", "_n")


def orphans(rows: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, if known, no parent of the tenant has."""
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    return rows.where(known).join(parent.select(*keys), keys, "left_anti")


def fingerprint(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``rows, content``: a table's row count and the order-independent sum of its rows' hashes, without secret columns."""
    cols = [c for c in sorted(df.columns) if c not in exclude]
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("content"))


def stale_recommendations(recommendations: DataFrame, changed: DataFrame) -> DataFrame:
    """Recommendations of changed requests become Stale."""
    hit = changed.select(ORG, "rfq_id").distinct().withColumn("_hit", F.lit(True))
    out = recommendations.join(hit, [ORG, "rfq_id"], "left")
    return out.withColumn("status", F.when(F.col("_hit"), "Stale").otherwise(F.col("status"))).drop("_hit")


def revisions(events: DataFrame, key: list[str], order: list[str], id_col: str) -> DataFrame:
    """Number the revisions of each key; the last is effective, each supersedes the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return (
        events.withColumn("revision_number", F.row_number().over(w))
        .withColumn("supersedes", F.lag(id_col).over(w))
        .withColumn("effective", F.lead(id_col).over(w).isNull())
    )


def effective_lines(lines: DataFrame, revised: DataFrame, revision_id: str) -> DataFrame:
    """Lines of effective revisions only: what a later offer no longer has is gone."""
    return lines.join(revised.where("effective").select(revision_id), revision_id, "left_semi")


def prior_quote(emails: DataFrame) -> DataFrame:
    """Add ``prior_quote_id``: that of the thread's last message before with one."""
    w = Window.partitionBy(ORG, "thread_id").orderBy("sent_at", "email_id").rowsBetween(Window.unboundedPreceding, -1)
    return emails.withColumn("prior_quote_id", F.last("quote_id", True).over(w))


def timeline(emails: DataFrame, order: list[str]) -> DataFrame:
    """Number the messages of a thread and name the role before each."""
    w = Window.partitionBy(ORG, "thread_id").orderBy(*order)
    return emails.withColumn("position", F.row_number().over(w)).withColumn("previous_role", F.lag("sender_role").over(w))


def gap_sessions(events: DataFrame, key: list[str], at: str, days: int = 30) -> DataFrame:
    """Number sessions of each key: a new one starts after more than ``days`` of silence."""
    w = Window.partitionBy(*key).orderBy(at)
    gap = F.coalesce(F.col(at).cast("timestamp") > F.lag(at).over(w).cast("timestamp") + F.expr(f"INTERVAL {days} DAYS"), F.lag(at).over(w).isNull())
    return events.withColumn("_new", gap.cast("int")).withColumn("session", F.sum("_new").over(w)).drop("_new")


written = shared_table


def thread_roots(messages: DataFrame) -> DataFrame:
    """``organization_id, message_id, root``: the smallest message id that reply references connect a message with.

    ``messages(organization_id, message_id, refs array<string>)``; references to unknown messages are ignored, null ids left out. Each round
    ties all larger neighbours of a message to its smallest one, then all smaller ones. What is aggregated are minima, a row a message and task;
    the neighbours of a message that many cite are joined with one row, which Spark may split, and never gathered. Rounds grow with the logarithm
    of the longest path; each is written to the shared folder.
    """
    ids = messages.where("message_id is not null").select(ORG, "message_id").distinct()
    cites = messages.select(ORG, F.col("message_id").alias("a"), F.explode("refs").alias("b")).where("a <> b")
    known = cites.join(ids.withColumnRenamed("message_id", "b"), [ORG, "b"], "left_semi")
    # (high, low): an edge from a message to a smaller one
    edges = written(known.select(ORG, F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges")
    before = None
    while True:
        around = edges.select(ORG, F.col("high").alias("at"), F.col("low").alias("near")).unionByName(edges.select(ORG, F.col("low").alias("at"), F.col("high").alias("near")))
        least = around.groupBy(ORG, "at").agg(F.min("near").alias("near")).select(ORG, "at", F.least("at", "near").alias("least"))
        larger = around.where("near > at").join(least, [ORG, "at"]).where("near <> least").select(ORG, F.col("near").alias("high"), F.col("least").alias("low")).distinct()
        lowest = larger.groupBy(ORG, "high").agg(F.min("low").alias("least"))
        smaller = larger.join(lowest, [ORG, "high"]).where("low <> least").select(ORG, F.col("low").alias("high"), F.col("least").alias("low"))
        edges = written(smaller.unionByName(lowest.select(ORG, "high", F.col("least").alias("low"))).distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64(ORG, "high", "low").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    roots = edges.select(ORG, F.col("high").alias("message_id"), F.col("low").alias("root"))
    return ids.join(roots, [ORG, "message_id"], "left").select(ORG, "message_id", F.coalesce("root", "message_id").alias("root"))
