"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are the digits of a number in several bases modulo a prime: H = sum of byte[i] * base^(n - 1 - i). The
fingerprint of two texts in a row follows from theirs by length-shifted arithmetic, H(xy) = H(x) * base^|y| + H(y), so the
chunks of a huge document are hashed by different tasks and their shifted hashes are summed. Texts of equal length and
fingerprint are then compared chunk by chunk with the row that stays; one that differs starts a class of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import MOST_SENT, fresh, numbered, small_batches, staged

#: The modulus (a prime, 2^31 - 1) and the bases: four residues are a fingerprint of 124 bits.
PRIME = 2**31 - 1
BASES = (1_103_515_245, 214_013_211, 1_664_525_013, 747_796_405)
#: Bytes of a chunk: longer texts are hashed in parts, and texts are compared in parts of this size.
CHUNK = 65_536
#: Bytes of a block: its digits times powers below the prime, summed, stay whole numbers of a double.
BLOCK = 64
#: Partitions of one fingerprint's rows, and members that are compared with one copy of a chunk of the row that stays.
SALTS, MEMBERS = 64, 1_000


class Polynomial:
    """Hashes of byte strings in the given bases, many strings at once."""

    def __init__(self, bases: Sequence[int] = BASES):
        self.bases = tuple(bases)
        self.within = np.array([[pow(b, BLOCK - 1 - i, PRIME) for b in self.bases] for i in range(BLOCK)], dtype=np.float64)
        self.shifts = np.ones((1, len(self.bases)), dtype=np.int64)

    def _shift(self, n: int) -> np.ndarray:
        """Powers of the bases for 0 to n - 1 blocks behind, doubled as needed."""
        while len(self.shifts) < n:
            by = np.array([pow(b, BLOCK * len(self.shifts), PRIME) for b in self.bases], dtype=np.int64)
            self.shifts = np.concatenate([self.shifts, self.shifts * by % PRIME])
        return self.shifts

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Hashes ``[string, base]`` of the strings between ``offsets`` of the bytes ``data``.

        Strings are laid out in whole blocks with zeros before them, which add nothing; a block is a row of a matrix
        product, and a string's blocks are shifted by the blocks behind them and summed.
        """
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        ends = np.cumsum(blocks)
        laid = np.zeros(int(ends[-1]) * BLOCK if len(ends) else 0, dtype=np.uint8)
        for a, b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (ends * BLOCK).tolist(), strict=True):
            laid[e - (b - a) : e] = data[a:b]
        out = np.zeros((len(sizes), len(self.bases)), dtype=np.int64)
        filled = np.flatnonzero(blocks)
        if len(filled):
            own = (laid.reshape(-1, BLOCK).astype(np.float64) @ self.within).astype(np.int64) % PRIME
            behind = np.repeat(ends, blocks) - 1 - np.arange(len(own))
            own = own * self._shift(int(blocks.max()))[behind] % PRIME
            out[filled] = np.add.reduceat(own, (ends - blocks)[filled], axis=0) % PRIME
        return out

    def shifted(self, hashes: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Hashes of strings that ``behind`` bytes follow."""
        out, behind = hashes.copy(), np.asarray(behind)
        for i in np.flatnonzero(behind):
            out[i] = [int(h) * pow(b, int(behind[i]), PRIME) % PRIME for h, b in zip(hashes[i], self.bases, strict=True)]
        return out


def combine(hashes: Sequence[Sequence[int]], sizes: Sequence[int], bases: Sequence[int] = BASES) -> list[int]:
    """The hash of strings in a row from theirs and their sizes."""
    total = [0] * len(bases)
    for own, n in zip(hashes, sizes, strict=True):
        total = [(t * pow(b, n, PRIME) + h) % PRIME for t, h, b in zip(total, own, bases, strict=True)]
    return total


def fingerprints(rows: DataFrame, raw: str, bases: Sequence[int] = BASES, chunk: int = CHUNK) -> DataFrame:
    """``rows``, of which ``raw`` is a binary column, with ``raw`` replaced by ``size`` and ``fingerprint`` (a long a base).

    Strings of at most ``chunk`` bytes are hashed where they lie. Longer ones are cut into chunks that are dealt out, hashed
    anywhere and shifted by the bytes behind them; a string's hash is the sum. Null is null. All other columns are
    grouped by, so they must be of kinds that can be (and repeated rows of a long string need a number to stay apart).
    """
    spark = rows.sparkSession
    small_batches(spark)
    others = [c for c in rows.columns if c != raw]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    data, size, at = fresh(rows, "data", "size", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Polynomial(bases)
        for b in batches:
            strings = b.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
            body = strings.buffers()[2]
            bytes_ = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
            own = hasher.shifted(hasher.hashes(bytes_, offsets), b.column(1).to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * len(bases), pa.int32()), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], lists], [*others, size, "own"])

    schema = f"{kinds}{', ' if kinds else ''}`{size}` long, own array<long>"
    length = F.octet_length(F.col(raw)).cast("long")
    whole = rows.where(length <= chunk).select(F.col(raw).alias(data), F.lit(0).cast("long").alias(at), *others, length.alias(size)).mapInArrow(run, schema)
    huge = rows.where(length > chunk).select("*", length.alias(size))
    starts = F.sequence(F.lit(0).cast("long"), F.col(size) - 1, F.lit(chunk).cast("long"))
    cut = huge.select("*", F.explode(starts).alias(at)).select(
        F.substring(F.col(raw), (F.col(at) + 1).cast("int"), F.lit(chunk)).alias(data), F.greatest(F.col(size) - F.col(at) - chunk, F.lit(0).cast("long")).alias(at), *others, size
    )
    parts = cut.repartition(*others, at).mapInArrow(run, schema)
    summed = parts.groupBy(*others, size).agg(*(F.sum(F.col("own")[i]).alias(f"own{i}") for i in range(len(bases))))
    joined = summed.select(*others, size, F.array(*(F.col(f"own{i}") % PRIME for i in range(len(bases)))).alias("own"))
    nulls = rows.where(F.col(raw).isNull()).select(*others, F.lit(None).cast("long").alias(size), F.lit(None).cast("array<long>").alias("own"))
    return whole.unionByName(joined).unionByName(nulls).withColumnsRenamed({size: "size", "own": "fingerprint"})


def classes(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rows(row, id, key, ...)`` with ``n``, the rows of its key, and ``best``, the ``(id, row)`` of its largest id (nulls
    before all others; of equal ids the largest row).

    A key's rows are spread over ``salts`` partitions; their sums meet once a key and go back to the partitions.
    """
    salted = rows.withColumn("salt", F.pmod("row", F.lit(salts)))
    own = salted.groupBy("key", "salt").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("best"))
    own = staged(own, "classes")
    total = own.groupBy("key").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    back = own.select("key", "salt").join(total, "key")
    return salted.join(back, ["key", "salt"]).drop("salt")


def differing(texts: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The ``row`` of those of ``members(row, lead, n)`` whose text differs from that of row ``lead``, which has the same
    size: ``texts(row, raw)`` are cut into chunks, and equal places meet, a chunk at a time.

    ``n`` is the number of members of a lead; each ``MEMBERS`` of them meet a copy of its chunks of their own.
    """
    wanted = members.select("row", "lead", F.ceil(F.col("n") / MEMBERS).cast("long").alias("copies"))
    wanted = staged(wanted, "members")
    few = wanted.count() <= MOST_SENT
    leads = wanted.groupBy("lead").agg(F.max("copies").alias("copies"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.octet_length("raw").cast("long") - 1, F.lit(0)), F.lit(chunk).cast("long"))
    piece = F.substring(F.col("raw"), (F.col("at") + 1).cast("int"), F.lit(chunk))

    def cut(own: DataFrame, *columns: Column) -> DataFrame:
        return own.select("*", F.explode(starts).alias("at")).select(*columns, "at", piece.alias("piece"))

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    mine = cut(texts.join(sent(wanted), "row"), F.col("row"), F.col("lead"), F.pmod("row", "copies").alias("copy"))
    first = texts.join(sent(leads.withColumnRenamed("lead", "led")), F.col("row") == F.col("led"))
    theirs = cut(first.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")), F.col("led").alias("lead"), F.col("copy"))
    met = mine.join(theirs.withColumnRenamed("piece", "other").hint("shuffle_hash"), ["lead", "copy", "at"])
    return met.where("piece <> other").select("row").distinct()


def exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] = lambda c: c, bases: Sequence[int] = BASES, chunk: int = CHUNK, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each row of ``docs(doc_id, text, ...)``: its ``columns`` and ``keep_id, group_size, kept, text_sha256``.

    Texts are equal if they are after ``normalise`` (a column function; none by default), null as the empty text. Of equal
    texts the row with the largest id stays, null ids before all others; of rows with that id just one. ``text_sha256``
    is that of the normalised text in UTF-8. Clashing names of other columns do no harm; no rows give no rows. Texts are written
    once with row numbers, and only those of classes of two rows or more are read again, to be compared with the
    row that stays. Fingerprints may collide: rows that differ from their class's are classed anew until none does.
    """
    own = docs.select(*(F.col(c).alias(f"own_{i}") for i, c in enumerate(columns)), F.col("doc_id").alias("id"), F.coalesce(normalise(F.col("text")), F.lit("")).cast("binary").alias("raw"))
    texts = numbered(own.withColumn("sha", F.unhex(F.sha2("raw", 256))), "row")
    names = [f"own_{i}" for i in range(len(columns))]
    prints = staged(fingerprints(texts.select("row", "id", "sha", *names, "raw"), "raw", bases, chunk), "prints")
    rows = prints.withColumn("key", F.struct("size", "fingerprint", F.lit(0).alias("round")))
    step = 0
    while True:
        grouped = classes(rows)
        new = grouped.where((F.col("n") > 1) & (F.col("key.round") == step) & (F.col("row") != F.col("best.row")))
        bad = staged(differing(texts.select("row", "raw"), new.select("row", F.col("best.row").alias("lead"), "n"), chunk), "differing")
        if bad.isEmpty():
            break
        step += 1
        again = F.struct(F.col("key.size").alias("size"), F.col("key.fingerprint").alias("fingerprint"), F.lit(step).alias("round"))
        rows = staged(rows.join(bad.select(F.col("row").alias("bad")), F.col("row") == F.col("bad"), "left").withColumn("key", F.when(F.col("bad").isNotNull(), again).otherwise(F.col("key"))).drop("bad"), "rows")
    return grouped.select(
        *(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
