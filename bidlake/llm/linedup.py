"""Line dedup over levelled sorted runs of line hashes.

A line's key is hashed to 128 bits. Documents come in batches; each batch is merge-anti-joined with the runs of
hashes that are already settled, and the counts of its other lines are added as a run of its own. A run is a table
bucketed and sorted by hash into as many buckets as Spark shuffles to, so runs are joined where they lie: neither a
join with a run nor the compaction of runs moves or deals them again. Once a level holds ``fan`` runs they are merged
into one run of the next level, and hashes that have reached the number of documents sought move to the settled runs,
so later batches need not carry them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm.common import fresh, once, shared_dir, small_batches, staged

SEEDS = (42, 7)
#: Documents of a batch.
BATCH_ROWS = 5_000_000
_BLANK = " \t\n\v\f\r"


def key_of(line: str) -> str:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(_BLANK).encode().lower().decode()


def hash_of(key: str) -> bytes:
    raw = key.encode()
    return b"".join(xxhash.xxh64_digest(raw, seed) for seed in SEEDS)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs as one: a merge join of tables that lie dealt and sorted by ``h``."""
    both = a.join(b.withColumnRenamed("n", "more").hint("merge"), "h", "full")
    return both.select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))


class SortedRuns:
    """Levels of runs ``(h, n)``, each a table bucketed and sorted by ``h``: ``n`` sums over the runs."""

    def __init__(self, spark: SparkSession, fan: int = 4):
        self.spark, self.fan, self.levels, self.names = spark, fan, [[]], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @property
    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` whose ``h`` is in no run: a merge anti-join with each. It is written as an outer join, since Spark
        moves anti-joins before the counting of a batch, where a frequent line is one task's."""
        for run in self.runs:
            met = run.select("h", F.lit(True).alias("met")).hint("merge")
            batch = batch.join(met, "h", "left").where("met is null").drop("met")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Add ``batch(h, n)`` as a run, and merge full levels."""
        self.levels[0].append(self._run(batch.groupBy("h").agg(F.sum("n").alias("n"))))
        level = 0
        while len(self.levels[level]) >= self.fan:
            if len(self.levels) == level + 1:
                self.levels.append([])
            full, self.levels[level] = self.levels[level], []
            out = full[0]
            for run in full[1:]:
                out = self._run(merged(out, run))
            self.levels[level + 1].append(out)
            level += 1

    def total(self) -> DataFrame | None:
        """All runs as one. Runs are merged two at a time, since only what is written as a run lies dealt and sorted."""
        out = None
        for run in self.runs:
            out = run if out is None else self._run(merged(out, run))
        return out

    def close(self) -> None:
        """Forget the tables' names; their files stay in the shared folder for those who still read them."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _run(self, rows: DataFrame) -> DataFrame:
        name = f"bidlake_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}"
        # rows are dealt by h to as many partitions already, so a bucket is one task's and one file
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)


def first_seen(lines: DataFrame, seen: SortedRuns) -> DataFrame:
    """Streaming use: of a batch ``lines(h, ...)`` the rows whose hash no earlier batch had; the batch's own hashes
    are then added. Null hashes are always new."""
    new = staged(seen.unseen(lines), "new")
    seen.add(new.where("h is not null").select("h").distinct().withColumn("n", F.lit(1).cast("long")))
    return new


def line_hashes(docs: DataFrame, batches: int) -> DataFrame:
    """``batch, h``: for every row of ``docs(doc_id, text, ...)`` the hash of each of its distinct keys that is not
    empty; rows are dealt to ``batches`` batches by their id."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, hs = [], []
            for batch, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys = {key_of(x) for x in (text.as_py() or "").split("\n")}
                own = [hash_of(k) for k in keys if k]
                at += [batch] * len(own)
                hs += own
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(hs, pa.binary())], ["batch", "h"])

    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), "text")
    return dealt.mapInArrow(run, "batch int, h binary")


def frequent(docs: DataFrame, min_docs: int, batches: int | None = None, fan: int = 2) -> DataFrame:
    """Hashes ``h`` of the keys that at least ``min_docs`` rows of ``docs`` hold, with that number ``n``, at least. The number of
    batches follows from that of documents unless given: one for each ``BATCH_ROWS``, from 4 to 64."""
    spark = docs.sparkSession
    batches = batches or max(4, min(64, docs.count() // BATCH_ROWS))
    lines = staged(line_hashes(docs, batches), "lines", "batch")
    counts, settled = SortedRuns(spark, fan), SortedRuns(spark, fan)
    for i in range(batches):
        counts.add(settled.unseen(lines.where(F.col("batch") == i).groupBy("h").agg(F.count("*").alias("n"))))
        if i and len(counts.runs) == 1 and i + 1 < batches:  # all is merged into one run
            settled.add(settled.unseen(counts.runs[0].where(F.col("n") >= min_docs)))
    out = staged(counts.total().where(F.col("n") >= min_docs), "frequent")
    counts.close()
    settled.close()
    return out


def _strip(text: str | None, dropped: frozenset | set) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    kept = [x for x in lines if hash_of(key_of(x)) not in dropped]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _result(rows: list[tuple[str, int, int]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


_KIND = "text string, n_lines long, n_dropped long"


def drop_frequent(docs: DataFrame, min_docs: int = 10, batches: int | None = None, fan: int = 2, max_sent: int = 200_000) -> DataFrame:
    """``docs(doc_id, text, ...)`` without the lines whose key at least ``min_docs`` rows hold, and ``n_lines`` (before
    that) and ``n_dropped``.

    Lines end at \\n; a key is a line stripped of ASCII white space, A-Z lower-cased; empty keys always stay. Null or
    empty text is one empty line and comes back empty. Rows that share an id count as documents of their own. An
    empty table stays empty. Columns of ``docs`` named like the new ones stay, which then get underscores in front.

    Up to ``max_sent`` hashes (16 bytes each) are broadcast; if there are more, each text finds its own dropped hashes
    by joins. Both ways give the same rows.
    """
    small_batches(docs.sparkSession)
    n_lines, n_dropped, got, key, mine = fresh(docs, "n_lines", "n_dropped", "got", "text_key", "drops")
    often = frequent(docs, min_docs, batches, fan).select("h")
    if often.limit(max_sent + 1).count() <= max_sent:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r["h"]) for r in often.collect()))

        @F.pandas_udf(_KIND)
        def strip(text: pd.Series) -> pd.DataFrame:
            return _result([_strip(x, sent.value) for x in text])

        out = docs.withColumn(got, once(strip)("text"))
    else:

        @F.pandas_udf(_KIND)
        def strip_own(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
            return _result([_strip(x, set() if d is None else set(map(bytes, d))) for x, d in zip(text, drops, strict=True)])

        keyed = docs.withColumn(key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        hashes = staged(_hashes_of_texts(keyed.select(F.col(key).alias("k"), "text")), "text_lines")
        hits = hashes.join(often, "h", "left_semi").groupBy("k").agg(F.collect_set("h").alias(mine))
        out = keyed.join(hits.withColumnRenamed("k", key), key, "left").withColumn(got, once(strip_own)("text", mine))
    cols = [F.col(f"{got}.text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, F.col(f"{got}.n_lines").alias(n_lines), F.col(f"{got}.n_dropped").alias(n_dropped))


def _hashes_of_texts(keyed: DataFrame) -> DataFrame:
    """``k, h``: the hashes of the keys of each text of ``keyed(k, text)``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ks, hs = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = {hash_of(key_of(x)) for x in (text.as_py() or "").split("\n")}
                ks += [k] * len(own)
                hs += own
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), pa.array(hs, pa.binary())], ["k", "h"])

    return keyed.mapInArrow(run, "k string, h binary").distinct()
