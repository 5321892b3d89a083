"""How filters interact: what each one removes in every order of application.

A document's failures are a mask of one bit a filter, so the documents of a part of the corpus are at most 2^k cells, each
with its sums. Subsets of filters are walked in Gray-code order: each move toggles one filter, which changes the counter of
active failures of the cells that fail it; a cell whose counter leaves zero goes from the running survivors, one whose
counter comes back to zero returns. The survivors of all 2^k subsets are kept as states, and each step of each order is the
difference of two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import fresh, small_batches, staged

#: Sums kept of each cell: documents, those of good quality, toxic ones.
MEASURES = ("n", "good", "toxic")
#: Parts of which the rows are made at once: 120 orders of five filters make 600 rows a part.
PARTS_AT_ONCE = 200
#: What a text alone tells.
FLAGS = ("few_words", "few_distinct", "capitals", "marks")
OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def walk(cells: np.ndarray) -> np.ndarray:
    """``cells[part, mask, measure]`` as ``states[part, subset, measure]``: the sums over cells that fail no filter of the
    subset. One filter is toggled a move; only cells that fail it are looked at."""
    masks = np.arange(cells.shape[1])
    active = np.zeros(len(masks), dtype=np.int64)
    alive = cells.sum(axis=1)
    states = np.empty_like(cells)
    states[:, 0] = alive
    subset = 0
    for move in range(1, len(masks)):
        f = (move & -move).bit_length() - 1
        failing = masks[masks >> f & 1 == 1]
        if subset >> f & 1:
            active[failing] -= 1
            alive = alive + cells[:, failing[active[failing] == 0]].sum(axis=1)
        else:
            alive = alive - cells[:, failing[active[failing] == 0]].sum(axis=1)
            active[failing] += 1
        subset ^= 1 << f
        states[:, subset] = alive
    return states


def steps(letters: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For all steps of all orders, in order: the order, the step from 1, its filter's number and the subset before it."""
    orders, step, own, before = [], [], [], []
    for order in permutations(range(len(letters))):
        done = 0
        for k, f in enumerate(order):
            orders.append("".join(letters[x] for x in order))
            step.append(k + 1)
            own.append(f)
            before.append(done)
            done |= 1 << f
    return orders, np.array(step), np.array(own), np.array(before)


def differences(cells: np.ndarray, letters: str) -> list[np.ndarray]:
    """The columns ``OUT`` for ``cells[part, mask, measure]``, each of parts times all steps of all orders."""
    k, states = len(letters), walk(cells)
    _, _, own, before = steps(letters)
    after = before | 1 << own
    lost = states[:, before] - states[:, after]
    masks = np.arange(1 << k)
    failing = np.stack([cells[:, masks >> f & 1 == 1, 0].sum(axis=1) for f in range(k)], axis=1)
    alone = np.stack([cells[:, 1 << f, 0] for f in range(k)], axis=1)
    shapley = np.zeros((len(cells), k), dtype=np.int64)
    for f in range(k):
        for s in masks[masks >> f & 1 == 0]:
            size = int(s).bit_count()
            shapley[:, f] += factorial(size) * factorial(k - 1 - size) * (states[:, s, 0] - states[:, s | 1 << f, 0])
    removed = lost[:, :, 0]
    return [states[:, after, 0], removed, failing[:, own] - removed, alone[:, own], lost[:, :, 1], lost[:, :, 2], shapley[:, own]]


def audit(failed: DataFrame, filters: Sequence[tuple[str, str]], part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """For ``failed``, a row a document with boolean columns, a row for each part, order of filters and step:
    ``part, filter_order, step`` and the longs ``OUT``.

    ``filters`` pairs one letter with the column that says whether a document fails. Null failures, labels and parts count
    as false, false and the empty string; other columns are ignored; repeated rows count as often as they stand. Rows are
    summed into cells before any shuffle, so a part of any size is 2^k rows a task. No rows give no rows.
    """
    letters, n_cells = "".join(x for x, _ in filters), 1 << len(filters)
    orders, step, _, _ = steps(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), PARTS_AT_ONCE):
                parts, found = (c.slice(lo, PARTS_AT_ONCE).to_pylist() for c in b.columns)
                cells = np.zeros((len(parts), n_cells, len(MEASURES)), dtype=np.int64)
                for i, own in enumerate(found):
                    for c in own:
                        cells[i, c["mask"]] = [c[m] for m in MEASURES]
                columns = [pa.array(c.ravel()) for c in differences(cells, letters)]
                names = [pa.array(np.repeat(parts, len(orders)), pa.string()), pa.array(orders * len(parts), pa.string()), pa.array(np.tile(step, len(parts)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*names, *columns], ["part", "filter_order", "step", *OUT])

    def whether(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`"), F.lit(False)).cast("int")

    mask = sum((whether(c) * (1 << i) for i, (_, c) in enumerate(filters)), F.lit(0))
    rows = failed.select(F.coalesce(F.col(f"`{part}`"), F.lit("")).cast("string").alias("part"), mask.alias("mask"), whether(good).alias("good"), whether(toxic).alias("toxic"))
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    whole = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))
    return whole.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in OUT))


def repeated(rows: DataFrame, digest: str) -> DataFrame:
    """``rows(doc_id, digest, ...)`` and the boolean ``repeated``: whether a row of a smaller id has the same digest.

    Null ids are neither smaller nor larger than others: such rows are not repeated. Only each digest's first row is found
    again, by digest and id together, so copies of one text do not meet in one task.
    """
    first, at = fresh(rows, "first", "at")
    firsts = rows.groupBy(F.col(digest).alias(at)).agg(F.min("doc_id").alias(first)).where(F.col(first).isNotNull())
    joined = rows.join(firsts, (F.col(digest) == F.col(at)) & (F.col("doc_id") == F.col(first)), "left")
    return joined.withColumn("repeated", F.col("doc_id").isNotNull() & F.col(first).isNull()).drop(first, at)


#: Bytes that stand for no code point of their own, capitals and marks.
_BEHIND, _CAPITALS, _MARKS = bytes(range(0x80, 0xC0)), bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"


def text_facts(raw: bytes) -> tuple[bytes, bool, bool, bool, bool]:
    """Of a text in UTF-8 the SHA-256 and whether it has few words, few distinct words, many capitals, a mark.

    ``bytes.split`` cuts at ASCII white space, which no other character's bytes hold.
    """
    words = raw.split()
    points = len(raw.translate(None, _BEHIND))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    marked = len(raw.translate(None, _MARKS)) < len(raw)
    return hashlib.sha256(raw).digest(), len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * points, marked


def text_failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, few_words, few_distinct, capitals, marks, repeated, good, toxic`` of ``docs(doc_id, text, ...)``.

    Fewer than 200 words; distinct words under half of all; capitals A-Z over a fiftieth of the code points; a mark of
    ``#$%&*|``; the text of a smaller id. Null texts are empty. ``labels(doc_id, quality, toxic)``: a document is good or
    toxic if a row of its id says so; ids without a row and null ids are neither. Texts are read once and stay where they
    are; what is shuffled is a digest, an id and six flags a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_facts(x.as_py() or b"") for x in b.column(2)]
            digests, *flags = zip(*found, strict=True) if found else ([],) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), *(pa.array(f, pa.bool_()) for f in flags)], ["doc_id", "part", "digest", *FLAGS])

    small_batches(docs.sparkSession)
    own = docs.select("doc_id", F.col(f"`{part}`").alias("part"), F.col("text").cast("binary").alias("raw"))
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("doc_id", "part"))
    facts = own.mapInArrow(run, f"{kinds}, digest binary, " + ", ".join(f"{c} boolean" for c in FLAGS))
    said = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = repeated(staged(facts, "facts"), "digest").drop("digest")
    return marked.join(said, F.col("doc_id") == F.col("labelled"), "left").drop("labelled")
