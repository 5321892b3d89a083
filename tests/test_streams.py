"""Late rows, restarts in the middle of a batch, threads by reference, components."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from bidlake.operators import changes
from bidlake.sources import sinks
from bidlake.streaming import feeds, late, threads

EVENTS = "id long, key string, at timestamp"


def day(d, h=0):
    return dt.datetime(2024, 1, d, h)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def sessions(rows):
    s = changes.gap_sessions(rows, ["key"], "at", 5)
    return s.groupBy("key").agg(F.max("session").cast("int").alias("sessions"), F.count("*").alias("n"), F.max("at").alias("last_message_at"))


def feed(spark, folder, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def test_late_rows_end_in_the_rows_of_one_batch(spark, folder):
    first = [(1, "a", day(1)), (2, "a", day(20)), (3, "b", day(20)), (4, None, day(3)), (5, "c", None)]
    second = [(6, "a", day(4)), (7, "a", day(8)), (8, "d", day(2)), (9, "b", day(21)), (10, None, day(20, 5))]
    for rows in (first, second):
        late.recomputed(feed(spark, folder, rows), "key", "at", 3600, sessions, f"{folder}/state", f"{folder}/cp").awaitTermination()
    got = {tuple(r) for r in late.current(spark, f"{folder}/state", "key").collect()}
    want = {tuple(r) for r in sessions(spark.createDataFrame(first + second, EVENTS)).collect() if r["key"] is not None}
    assert got == want and ("a", 2, 4, day(20)) in got
    assert {r["id"] for r in late.late_rows(spark, f"{folder}/state").collect()} == {6, 7, 8}


def test_a_batch_that_fails_after_writing_is_not_doubled(spark, folder):
    schema = "organization_id string, id long, old struct<v:int>, new struct<v:int>"
    source = feed(spark, folder, [("o", 1, (1,), (2,)), ("o", 2, (1,), (3,))], schema)

    def failing(batch, epoch):
        sinks.put_epoch(sinks.audit_rows(batch, "CHANGED", "x", "id", F.col("old"), F.col("new")), epoch, f"{folder}/audit")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        source.writeStream.foreachBatch(failing).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{folder}/audit").count() == 2
    for _ in range(2):
        feeds.audit_stream(source, "CHANGED", "x", "id", f"{folder}/audit", f"{folder}/cp").awaitTermination()
    rows = spark.read.parquet(f"{folder}/audit").collect()
    assert sorted(r["entity_id"] for r in rows) == ["1", "2"] and {r["old_values"] for r in rows} == {'{"v":1}'}


def test_finding_changes(spark, folder):
    schema = "quote string, code string"
    for rows in ([("q1", "A"), ("q1", "A"), ("q1", "B")], [("q1", "A"), ("q2", "A"), ("q1", "C")]):
        feeds.finding_changes(feed(spark, folder, rows, schema), ["quote", "code"], f"{folder}/seen", f"{folder}/new", f"{folder}/cp").awaitTermination()
    got = sorted((r["quote"], r["code"], r["epoch"]) for r in spark.read.parquet(f"{folder}/new").collect())
    assert got == [("q1", "A", 0), ("q1", "B", 0), ("q1", "C", 1), ("q2", "A", 1)]


def test_threads_by_reference(spark, folder):
    schema = "subject string, id string, at timestamp, refs array<string>, supplier string, rfq string"
    first = [("s", "m3", day(3), ["m1"], None, None), ("s", "m1", day(1), [], "x", None), ("s", "m2", day(2), None, "y", None), ("s", "m4", day(4), [None, "zz"], "x", "r"), ("t", "m5", day(4), ["m1"], None, None), ("s", "end", day(20), [], None, None)]
    second = [("s", "m6", day(21), ["m4"], "y", None), ("s", "m7", day(22), ["gone"], "x", None), ("s", "m8", day(23), [], "q", None), ("s", "last", day(28), [], None, None)]
    for rows in (first, second):
        source = feed(spark, folder, rows, schema)
        out = feeds.drained(threads.reference_threads(source, "subject", "id", "at", "refs", "supplier", "rfq", 10, "1 day"), folder, threads.to_table)
    got = {(r["key"], r["id"]): (r["thread"], r["method"]) for r in out.collect()}
    assert got == {
        ("s", "m1"): (1, "NEW"), ("s", "m2"): (2, "NEW"), ("s", "m3"): (1, "REFERENCE"), ("t", "m5"): (1, "NEW"), ("s", "m4"): (3, "NEW"),
        ("s", "end"): (4, "NEW"), ("s", "m6"): (3, "REFERENCE"), ("s", "m7"): (3, "SUBJECT"), ("s", "m8"): (5, "NEW"),
    }


def test_thread_roots(spark):
    rnd = random.Random(1)
    ids = [f"m{i}" for i in range(300)]
    rows = [("o", i, rnd.sample(ids + ["unknown"], rnd.choice([0, 0, 1, 1, 2]))) for i in ids] + [("o", f"c{i:03}", [f"c{i + 1:03}"]) for i in range(99)] + [("o", "c099", None), ("p", "m1", ["m2"]), ("p", "m2", ["m2"]), ("o", None, ["m1"])]
    got = {(r["organization_id"], r["message_id"]): r["root"] for r in changes.thread_roots(spark.createDataFrame(rows, "organization_id string, message_id string, refs array<string>")).collect()}
    up = {(o, m): (o, m) for o, m, _ in rows if m}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for o, m, refs in rows:
        for r in refs or []:
            if m and (o, r) in up:
                a, b = sorted((find((o, m)), find((o, r))))
                up[b] = a
    assert got == {k: find(k)[1] for k in up}
    assert changes.thread_roots(spark.createDataFrame([], "organization_id string, message_id string, refs array<string>")).count() == 0


def test_folders_of_this_machine_only_in_local_mode(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        sinks.shared_folder(Cluster)
