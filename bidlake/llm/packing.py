"""Best-fit decreasing packing of token sequences.

Pieces of one length are alike to the packer, so it needs only how many there are of each length: at most ``capacity``
rows, whatever the corpus. Going through the lengths from the longest down, a segment tree over remaining capacities
finds the tightest open bins that still fit in logarithmic time, and as many equal pieces as these equal bins hold go
there at once. That gives the bins that placing document by document gives. The plan is a list of runs (so many
pieces of this length to so many equal bins), at most a few for each pair of a length and a remaining capacity; every
piece then finds its run by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import fresh, small_batches, staged

#: Distinct words of which a worker keeps the ids, the most characters of such a word, and the word that separates words in
#: one call of the tokenizer.
KEPT_WORDS, KEPT_CHARS, MARK = 400_000, 40, "\x00"
#: Marks that a pre-tokenizer may cut off behind letters.
TAIL = ".,;:!?#$%&*"
_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """A tokenizer that lower-cases, whose pre-tokenizer never joins what ASCII white space separates and that drops
    white space: a text's ids are then its words' ids, one after the other, so each distinct word needs to be encoded
    once. Texts of Latin-1 are composed as they are, and lower-casing them is the same everywhere; their words skip the
    tokenizer's normaliser. Where the pre-tokenizer cuts marks off behind letters, which is looked up for each mark, letters and
    marks are encoded apart, so that a word is encoded once whatever follows it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.known: dict[str, bytes] = {}
        pieces = [self.tokenizer.pre_tokenizer.pre_tokenize_str(f"ab{c}{TAIL}") for c in TAIL] if self.tokenizer.pre_tokenizer else []
        self.cuts = bool(pieces) and all(len(p) == 2 and p[0][0] == "ab" for p in pieces)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def encode(self, words: list[str], step: int = 20_000) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word."""
        if self.cuts:
            cut = {}
            for w in words:
                core = w.rstrip(TAIL)
                if len(core) < len(w) and core.isalpha() and _latin(core):
                    cut[w] = core
            if cut:
                parts = {*cut.values(), *(w[len(core) :] for w, core in cut.items())}
                ids = {w: self.known[w] for w in parts if w in self.known}
                ids |= self._encoded([w for w in {*parts, *words} if w not in cut and w not in ids], step)
                return {w: ids[cut[w]] + ids[w[len(cut[w]) :]] if w in cut else ids[w] for w in words}
        return self._encoded(words, step)

    def _encoded(self, words: list[str], step: int) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        sides: tuple[list[str], list[str], list[str]] = ([], [], [])
        for w in words:
            sides[2 if MARK in w or len(self.mark) != 1 else 0 if _latin(w) and w == w.lower() else 1].append(w)
        for side, tokenizer in zip(sides, (self.plain, self.tokenizer), strict=False):
            for lo in range(0, len(side), step):
                own = side[lo : lo + step]
                ids = np.array(tokenizer.encode_batch_fast([f" {MARK} ".join(own)], add_special_tokens=False)[0].ids, dtype="<u4")
                found.update(zip(own, _split(ids, self.mark[0]), strict=True))
        for w, e in zip(sides[2], self.tokenizer.encode_batch_fast(sides[2], add_special_tokens=False), strict=True):
            found[w] = np.array(e.ids, dtype="<u4").tobytes()
        return found

    def texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        # special tokens are matched as written, before the normaliser
        split = [_words(x.lower() if _latin(x) and "<|" not in x else x) for x in texts]
        known = self.known
        new = self.encode(list({w for ws in split for w in ws if w not in known}))
        room = KEPT_WORDS - len(known)
        known.update(new)
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for i, w in enumerate(new):  # a worker's memory follows from KEPT_WORDS and KEPT_CHARS, whatever the words
            if i >= room or len(w) > KEPT_CHARS:
                del known[w]
        return out


def _latin(text: str) -> bool:
    """Whether all characters are of Latin-1, without its own white space."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "\x85" not in text and "\xa0" not in text


def _words(text: str) -> list[str]:
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def _split(ids: np.ndarray, mark: int) -> list[bytes]:
    raw, at = ids.tobytes(), np.flatnonzero(ids == mark) * ids.itemsize
    starts, ends = [0, *(at + ids.itemsize).tolist()], [*at.tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, batch_chars: int = 1_500_000) -> DataFrame:
    """Encode ``docs(doc_id, text, ...)`` and cut it: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and ``end_id`` (null text: only that). Documents longer than ``capacity`` are cut into
    pieces of that many ids, the last as long as the rest. Rows that share an id each give their pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordTokenizer.of(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < batch_chars):
                    chars += len(texts[hi] or "")
                    hi += 1
                rows = []
                for i, ids in enumerate(encoder.texts([x or "" for x in texts[lo:hi]])):
                    ids += end
                    n = len(ids) // 4
                    rows += [(lo + i, k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
                at, k, s, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(at)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, n, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                lo = hi

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over the remaining capacities 0..n: which have open bins, and the least of them from some size on."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        i = size + self.leaves
        while not self.open[i]:
            while i & 1:
                i //= 2
                if i <= 1:
                    return None
            i += 1
            if i == 1 or i >= 2 * self.leaves:
                return None
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over ``counts`` (pieces of each length): the runs ``(length, first rank, first bin, pieces
    a bin, offset)`` in order of rank, and the number of bins. A run holds the pieces from its first rank to the next
    run's, dealt to consecutive bins."""
    tree, bins = CapacityTree(capacity), 0
    free: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: (first bin, bins)
    runs = []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not free.get(room):
                free[room] = []
                tree.set(room, True)
            free[room].append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // size))
                bins += n
            else:
                first, n = free[room].pop()
                if not free[room]:
                    tree.set(room, False)
            each = room // size
            full, rest = min(n, left // each), 0
            if full < n and left - full * each:
                rest = left - full * each
            runs.append((size, rank, first, each, capacity - room))
            put(room - each * size, first, full)
            if rest:
                put(room - rest * size, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            rank += full * each + rest
            left -= full * each + rest
    return runs, bins


def pack(cut: DataFrame, capacity: int = 2048, part_rows: int = 500_000) -> DataFrame:
    """Add ``sequence_id, offset`` to the rows of ``cut(doc_id, piece, length, ...)``, lengths 1 to ``capacity``.

    A piece as long as a sequence is one, numbered where it lies. The rank of any other among the pieces of its length is
    the number of such pieces in earlier parts (by a hash of the id) and its place in its own part; there are so many parts
    that no task sorts more than about ``part_rows`` rows of a length. Rows that are equal in all columns get different
    places. No rows: no rows. Columns of ``cut`` named like the new ones stay, which then get underscores in front.
    """
    sequence, at_offset, part, own_rank, before_rank, rank, at = fresh(cut, "sequence_id", "offset", "part", "own", "before", "rank", "at")
    cut = staged(cut, "pieces")
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    sizes.pop(capacity, None)
    runs, bins = best_fit(sizes, capacity)
    full = cut.where(F.col("length") == capacity)
    full = full.withColumn(sequence, F.monotonically_increasing_id() + bins).withColumn(at_offset, F.lit(0).cast("long"))
    if not sizes:
        return full
    parts = -(-max(sizes.values()) // part_rows)
    rest = cut.where(F.col("length") < capacity).withColumn(part, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    counts = staged(rest.groupBy("length", part).agg(F.count("*").alias("n")), "counts")
    by_length: dict[int, tuple[list[int], list[tuple[int, int, int, int]]]] = {}
    for size, first, *where in runs:
        ranks, places = by_length.setdefault(size, ([], []))
        ranks.append(first)
        places.append((first, *where))
    before = F.sum("n").over(Window.partitionBy("length").orderBy(part)) - F.col("n")
    own = F.row_number().over(Window.partitionBy("length", part).orderBy("doc_id", "piece", "start")) - 1
    ranked = rest.withColumn(own_rank, own).join(counts.withColumn(before_rank, before).drop("n"), ["length", part])
    ranked = ranked.withColumn(rank, F.col(before_rank) + F.col(own_rank))
    runs_of = cut.sparkSession.sparkContext.broadcast(by_length)  # bounded by the capacity, not by the corpus

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.empty((len(length), 2), dtype=np.int64)
        for size, rows in pd.Series(np.arange(len(length))).groupby(length.to_numpy()):
            ranks, places = runs_of.value[size]
            mine = rank.to_numpy()[rows]
            first, bin0, each, offset = np.array(places, dtype=np.int64)[np.searchsorted(ranks, mine, side="right") - 1].T
            out[rows] = np.stack([bin0 + (mine - first) // each, offset + (mine - first) % each * size], axis=1)
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    kept = [F.col(f"`{c}`") for c in cut.columns]
    placed = ranked.withColumn(at, place("length", rank)).select(*kept, F.col(f"{at}.sequence_id").alias(sequence), F.col(f"{at}.offset").alias(at_offset))
    return placed.unionByName(full)


def run_of(runs: list[tuple[int, int, int, int, int]], size: int, rank: int, capacity: int) -> tuple[int, int]:
    """Bin and offset of one piece."""
    own = [r for r in runs if r[0] == size]
    _, first, bin0, each, offset = own[bisect_right([r[1] for r in own], rank) - 1]
    return bin0 + (rank - first) // each, offset + (rank - first) % each * size


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves, ``sequence_id, ids array<int>, doc_ids array``, for ``docs`` with unique ids:
    at most ``capacity`` ids meet in a group."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordTokenizer.of(tokenizer)
        for b in batches:
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in encoder.texts([x or "" for x in b["text"]])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [np.append(x, np.int32(end_id)) for x in ids]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select("doc_id", "text").mapInPandas(encode, f"doc_id {kind}, ids array<int>")
    own = packed.join(ids, packed["doc_id"].eqNullSafe(ids["doc_id"])).select(
        "sequence_id", "offset", packed["doc_id"], F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")
    )
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return own.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.flatten("r.ids").alias("ids"), F.col("r.doc_id").alias("doc_ids"))
