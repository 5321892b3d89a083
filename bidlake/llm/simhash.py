"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 2 bits differ in at most 2 of their 8 bytes, so they share at least 6
positional bytes. The index lists each fingerprint under 14 sets of four positional bytes, chosen so that any two
bytes lie outside exactly 3 of the sets: fingerprints that differ in two bytes meet in 3 lists, in one byte in 7, in
more bytes in at most one. So the lists in which a pair meets are tallied, pairs below 3 go, and the rest are verified
by Hamming distance. The members of a list that is too long go under all sets of six bytes instead, where sharing one
is enough. Where even such a list is too long, its members look up what differs from them in few bits of the two bytes
left, so no list emits all its pairs. Equal fingerprints are one node from the start, so copies make no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import fresh, numbered, one_of_each, small_batches, staged
from bidlake.llm.graph import components

SEED, BITS, BYTES = 42, 64, 8
#: The sets of four bytes: byte positions whose bits selected by ``a`` have an even, or an odd, number of ones.
PLANES = [tuple(i for i in range(BYTES) if (a & i).bit_count() % 2 == odd) for a in range(1, BYTES) for odd in (0, 1)]
#: Sets that two bytes lie outside of, which is how many lists close fingerprints meet in at least.
LEAST_MET = 3
#: Sets of six bytes, of which close fingerprints share one.
NARROW = list(combinations(range(BYTES), 6))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 hashes of a text's word shingles, repeats included. A-Z are lower-cased; fewer words than a shingle are one
    shingle; no words give none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: max(1, len(words) - shingle + 1)].tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(starts))


def bits_of(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned integer; 0 if there are none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(h), 4096):
        ones += np.unpackbits(h[lo : lo + 4096].astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned integer: of the hashes of its word shingles the bits set in over half; no words
    give 0."""
    return bits_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, name: str = "fp", shingle: int = 3) -> DataFrame:
    """``doc_id`` and the fingerprint, as a signed long, of every row of ``docs(doc_id, text, ...)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", name])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {name} long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * (BYTES - 1 - i)).bitwiseAND(F.lit(255))


def _lists(fps: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """The inverted index: every fingerprint under each set of its positional bytes."""
    keys = [F.struct(F.lit(n).alias("at"), reduce(lambda k, i: k * 256 + _byte(F.col("fp"), i), s, F.lit(0).cast("long")).alias("bytes")) for n, s in enumerate(sets)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.at", "k.bytes")


def _pairs(lists: DataFrame, max_bits: int, least_met: int) -> DataFrame:
    """Pairs that meet in at least so many lists and differ in at most ``max_bits`` bits."""
    a, b = lists.alias("a"), lists.alias("b")
    same = (F.col("a.at") == F.col("b.at")) & (F.col("a.bytes") == F.col("b.bytes")) & (F.col("a.fp") < F.col("b.fp"))
    met = a.join(b, same).groupBy(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).agg(F.count("*").alias("met"))
    counted = met.where(F.col("met") >= least_met).select("a", "b")
    return counted.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)


def _flipped(lists: DataFrame, fps: DataFrame, max_bits: int) -> DataFrame:
    """Links within lists of six shared bytes: members with up to ``max_bits`` of the 16 bits left flipped, where ``fps``
    has them. A member looks up 136 values at most, however long its list is."""
    masks = [sum(1 << b for b in bits) for n in range(1, max_bits + 1) for bits in combinations(range(16), n)]
    if not masks:
        return lists.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    left = [[8 * (BYTES - 1 - i) for i in range(BYTES) if i not in s] for s in NARROW]
    high, low = (F.element_at(F.array(*(F.lit(x[k]) for x in left)), F.col("at") + 1) for k in (0, 1))
    asked = lists.select("fp", high.alias("high"), low.alias("low"), F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("m"))
    flip = F.expr("shiftleft(shiftright(m, 8), high) | shiftleft(m & 255, low)")
    asked = asked.select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(flip).alias("b")).where("a < b")
    return asked.join(fps.select(F.col("fp").alias("b")), "b").select("a", "b").distinct()


def links(fps: DataFrame, max_bits: int = 2, long_list: int = 128) -> DataFrame:
    """All pairs ``a < b`` of the distinct fingerprints ``fps(fp)`` that differ in at most ``max_bits`` (up to 2) bits.

    Lists of up to ``long_list`` members are paired at once, so the pairs are at most that many times the members;
    members of longer lists are listed again under six bytes, and in lists that are still longer each looks up its
    neighbours by flipping bits of the two bytes left. A pair of which a list is long is found there, all others meet
    in as many short lists as the count asks for.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2: six shared bytes are guaranteed for these only")
    short, longer = _by_length(staged(_lists(fps, PLANES), "lists"), long_list)
    found = _pairs(short, max_bits, LEAST_MET)
    if longer.isEmpty():
        return found
    narrow, dense = _by_length(staged(_lists(longer.select("fp").distinct(), NARROW), "narrow"), long_list)
    return found.unionByName(_pairs(narrow, max_bits, 1)).unionByName(_flipped(dense, fps, max_bits)).distinct()


def _by_length(lists: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of lists of two and up to ``most`` members, and those of longer ones."""
    sizes = lists.groupBy("at", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    several = staged(lists.join(staged(sizes, "sizes"), ["at", "bytes"]), "several")
    return several.where(F.col("n") <= most).drop("n"), several.where(F.col("n") > most).drop("n")


def near_duplicates(docs: DataFrame, max_bits: int = 2, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id long, text, ...)``: component_id is the
    smallest doc_id reached by links of at most ``max_bits`` differing bits.

    Null and empty texts have fingerprint 0 and link like any other; rows of one fingerprint (copies, repeated rows)
    are one component; a null doc_id gets its component's smallest id and is never one (null if there is no other).
    No rows: no rows.
    """
    own = staged(fingerprints(docs, "fp", shingle), "fingerprints")
    nodes = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    hung = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(hung, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = rooted.join(least, "root").select(F.col("fp").alias("node"), "component_id")
    return own.join(ids, F.col("fp") == F.col("node")).select("doc_id", F.lpad(F.lower(F.hex("fp")), BYTES * 2, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, max_bits: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each component of ``docs``, in the columns of ``docs``: that with the smallest id. Null ids come after
    all others, and rows that share an id are rows of their own."""
    (row,) = fresh(docs, "row_number")
    rows = numbered(docs, row)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), max_bits, shingle)
    return one_of_each(rows, row, found.select("doc_id", "component_id"))
