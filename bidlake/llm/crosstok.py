"""Alignment of two tokenizers' tokens, and how often tokens of the one meet tokens of the other.

Both sides' tokens cover the same bytes. All documents of a batch are merged in lockstep: one state vector holds for each of
them a pointer into its A and into its B tokens; a step links the tokens pointed at, cuts where both end, and moves the
pointers whose token ends first. Finished documents leave the vector. A long document has several places in it, from
common ends on, so that a batch takes as many steps as a stretch of tokens, not as its longest document.

How often a pair of ids is linked is summed over the corpus. The most frequent pairs, a bounded number, go to all tasks;
the others, none of which is frequent then, meet the documents by a join.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import small_batches, staged

#: Distinct units of which a worker keeps the ids, and the most characters of such a unit.
KEPT_UNITS, KEPT_CHARS = 200_000, 40
#: Units that are encoded in one call of a tokenizer, as one text.
JOINED = 200
#: Characters of the texts merged at once, and tokens after which a long document gets another place in the state vector.
BATCH_CHARS, STRETCH = 800_000, 256
#: Pairs of ids that are broadcast with their counts: at most so many, 17 bytes each.
MOST_PAIRS = 500_000
#: Unicode's white space, as the byte-level tokenizer's pattern means it; the sign that pieces have for a space.
_OTHER_SPACE, _PIECE_SPACE = r"\t\x0b-\r\x85\xa0  -     　", "▁"
_SPACE = rf" \n{_OTHER_SPACE}"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_encoders: dict = {}


#: From a space or a line end behind other characters to the next one.
_UNIT = re.compile(rf"[ \n][{_SPACE}]*[^{_SPACE}]*(?:[{_OTHER_SPACE}][{_SPACE}]*[^{_SPACE}]*)*")


class UnitEncoder:
    """Encodes texts unit by unit, each distinct unit once. A unit is white space that starts with a space or a line end, and what follows
    it; neither tokenizer has tokens that reach over its end, and what it becomes does not depend on the units around it."""

    #: What stands before a text that is encoded, and how many ids that and the tokenizer's own signs make.
    lead, lead_ids = "", 0

    def __init__(self, tables: list[bytes]):
        self.tables, self.sizes = tables, np.array([len(x) for x in tables], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts as they are."""
        raise NotImplementedError

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tables.__getitem__, ids.tolist()))

    def learn(self, units: list[str]) -> None:
        """Encode new units. Those that end with no white space are joined to texts, whose ids are told apart by the bytes that they
        stand for; the others, and all of a text whose tokens stand for other bytes, are encoded alone."""
        joinable = [u for u in units if not u[-1].isspace()]
        parts = [joinable[lo : lo + JOINED] for lo in range(0, len(joinable), JOINED)]
        texts = ["".join(p) for p in parts]
        alone = [u for u in units if u[-1].isspace()]
        for p, text, own in zip(parts, texts, self.encode([self.lead + t for t in texts]), strict=True):
            ids, raw = np.array(own[self.lead_ids :], dtype="<u4"), text.encode()
            if self.bytes_of(ids) != raw:
                alone += p
                continue
            sizes = [len(u) for u in p] if len(raw) == len(text) else [len(u.encode()) for u in p]
            stops = (np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(sizes)) + 1) * 4
            known, flat, at = self.known, ids.tobytes(), 0
            for u, stop in zip(p, stops.tolist(), strict=True):
                known[u] = flat[at:stop]
                at = stop
        for u, own in zip(alone, self.encode([self.lead + u for u in alone]), strict=True):
            ids = np.array(own[self.lead_ids :], dtype="<u4")
            self.known[u] = ids.tobytes()
            if self.bytes_of(ids) != u.encode():
                self.odd.add(u)

    def ids_of(self, text: str, units: list[str]) -> bytes:
        """Little-endian 32-bit ids of a text's units; none where the tokens' bytes are not the text's."""
        ids = b"".join(map(self.known.__getitem__, units))
        if self.odd and not self.odd.isdisjoint(units) and self.bytes_of(np.frombuffer(ids, "<u4")) != text.encode():
            return b""
        return ids

    def forget(self, units: list[str]) -> None:
        for u in units:
            del self.known[u]
            self.odd.discard(u)


class ByteLevel(UnitEncoder):
    """A byte-level tokenizer whose pattern takes runs of letters, digits or marks with at most one space before them, and white
    space that no such run takes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # printable bytes stand for themselves, the others for characters from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        super().__init__([bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entries])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces(UnitEncoder):
    """A piece tokenizer that puts a space before a text. No piece holds a line end beside another character, or a space behind
    one."""

    # the model puts a space before a text; a line end keeps it apart from the first unit
    lead, lead_ids = "\n", 2

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(len(e) > 1 and re.search(f"[ \n{_PIECE_SPACE}]", e.lstrip(_PIECE_SPACE)) for e in entries):
            raise ValueError("pieces reach over spaces or line ends: texts can't be cut there")
        byte = [_BYTE_PIECE.fullmatch(e) for e in entries]
        super().__init__([bytes([int(b[1], 16)]) if b else e.replace(_PIECE_SPACE, " ").encode() for e, b in zip(entries, byte, strict=True)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def encoder(kind: type[UnitEncoder], path: str) -> UnitEncoder:
    if path not in _encoders:
        _encoders[path] = kind(path)
    return _encoders[path]


def encoded(texts: list[str], a: UnitEncoder, b: UnitEncoder) -> tuple[list[bytes], list[bytes]]:
    """Ids of a space and each text by both tokenizers; none for empty texts and where either's bytes are not the text's."""
    spaced = [f" {t}" if t else "" for t in texts]
    split = [_UNIT.findall(t) for t in spaced]
    new = list(set().union(*split).difference(a.known))
    room = max(KEPT_UNITS - len(a.known), 0)
    for side in (a, b):
        side.learn(new)
    both = [(x, y) if (x := a.ids_of(t, units)) and (y := b.ids_of(t, units)) else (b"", b"") for t, units in zip(spaced, split, strict=True)]
    passing = new[room:] + [u for u in new[:room] if len(u) > KEPT_CHARS]
    for side in (a, b):
        side.forget(passing)
    return [x for x, _ in both], [y for _, y in both]


def places(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Where merges begin: at documents' starts, and every ``stretch`` tokens or so behind the next common end."""
    n = np.diff(np.append(starts_a, len(ends_a)))
    more = np.maximum(n // stretch - 1, 0)
    at = np.repeat(starts_a, more) + (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1) * stretch
    met = np.searchsorted(ends_b, ends_a[at])
    while len(apart := np.flatnonzero(ends_b[met] != ends_a[at])):
        at[apart] += 1
        met[apart] = np.searchsorted(ends_b, ends_a[at[apart]])
    a, b = np.concatenate([starts_a, at + 1]), np.concatenate([starts_b, met + 1])
    a, first = np.unique(a, return_index=True)
    used = a < len(ends_a)
    return a[used], b[first][used]


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links ``(A token, B token)`` in order, and which of them end in a cut.

    ``ends_*`` are the bytes at which tokens end, counted through the whole batch; merges start at the sorted ``starts_*``,
    at the same byte on both sides, and end where the next one starts.
    """
    i, j, stop = starts_a.copy(), starts_b.copy(), np.append(starts_a[1:], len(ends_a))
    linked_a = np.full(len(ends_a) + len(ends_b), -1, dtype=np.int64)
    cut = np.zeros(len(linked_a), dtype=bool)
    while len(i):
        a, b = ends_a[i], ends_b[j]
        linked_a[i + j] = i  # a document's links have sums of their own, in order
        cut[(i + j)[a == b]] = True
        i, j = i + (a <= b), j + (b <= a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    at = np.flatnonzero(linked_a >= 0)
    return linked_a[at], at - linked_a[at], cut[at]


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat.astype(np.int32)))


def aligned(ids_a: list[bytes], ids_b: list[bytes], a: UnitEncoder, b: UnitEncoder) -> list[pa.ListArray]:
    """The columns ``a_ids, b_ids, link_a, link_b, cut_a, cut_b`` of a batch of documents."""
    n_a, n_b = (np.array([len(x) // 4 for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.frombuffer(b"".join(ids), "<u4") for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(a.sizes[flat_a]), np.cumsum(b.sizes[flat_b])
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    i, j, cut = lockstep(ends_a, ends_b, *places(ends_a, ends_b, first_a, first_b))
    doc = np.repeat(np.arange(len(n_a)), n_a)[i]
    i, j = i - first_a[doc], j - first_b[doc]
    links, cuts = np.bincount(doc, minlength=len(n_a)), np.bincount(doc[cut], minlength=len(n_a))
    return [_lists(flat_a, n_a), _lists(flat_b, n_b), _lists(i, links), _lists(j, links), _lists(i[cut] + 1, cuts), _lists(j[cut] + 1, cuts)]


ALIGNED = ("a_ids", "b_ids", "link_a", "link_b", "cut_a", "cut_b")


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """``doc_id`` and the lists ``a_ids, b_ids`` (ids of a space and the text by both tokenizers, special tokens' strings as plain
    text), ``link_a, link_b`` (positions of tokens whose bytes overlap, in order) and ``cut_a, cut_b`` (tokens before
    each byte offset at which tokens of both end) of ``docs(doc_id, text, ...)``.

    ``byte_level`` is the file of a byte-level tokenizer (A), ``pieces`` that of a piece model (B). Texts that are null or
    empty, and those that a tokenizer does not keep byte by byte, have empty lists. A row is one row, repeated or not; other
    columns are left out; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = encoder(ByteLevel, byte_level), encoder(Pieces, pieces)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, chars = lo + 1, len(texts[lo])
                while hi < len(texts) and chars + len(texts[hi]) <= BATCH_CHARS:
                    chars += len(texts[hi])
                    hi += 1
                columns = aligned(*encoded(texts[lo:hi], a, b), a, b)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], ["doc_id", *ALIGNED])
                lo = hi

    small_batches(docs.sparkSession, 250)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in ALIGNED))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values in a row and their number by list."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


class GroupText:
    """Groups written as ``a1,a2|b1;a3|b2,b3``: each token is its digits and the mark behind it."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def digests(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, cuts: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups; the empty string without tokens. ``cut_*`` count tokens within documents."""
        if not len(a):
            return [""] * len(n_a)
        self.words += [f"{i}{m}".encode() for i in range(len(self.words) // 4, int(max(a.max(), b.max())) + 1) for m in ",|,;"]
        own = np.repeat(np.arange(len(cuts)), cuts)
        end_a, end_b = cut_a + (np.cumsum(n_a) - n_a)[own], cut_b + (np.cumsum(n_b) - n_b)[own]
        mark_a, mark_b = np.zeros(len(a), dtype=np.int64), np.full(len(b), 2)
        mark_a[end_a - 1], mark_b[end_b - 1] = 1, 3
        # the tokens of the other side that stand before a token are those of the groups before it, or up to its own
        at_a = np.arange(len(a)) + np.concatenate([[0], end_b[:-1]]).repeat(np.diff(end_a, prepend=0))
        at_b = np.arange(len(b)) + end_a.repeat(np.diff(end_b, prepend=0))
        laid = np.empty(len(a) + len(b), dtype=np.int64)
        laid[at_a], laid[at_b] = 4 * a + mark_a, 4 * b + mark_b
        out, at, word = [], 0, self.words.__getitem__
        for end in np.cumsum(n_a + n_b).tolist():
            out.append(hashlib.sha256(b"".join(map(word, laid[at:end].tolist()))[:-1]).hexdigest() if end > at else "")
            at = end
        return out


def summaries(alignments: DataFrame) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` of the rows of ``align``: ``pairs`` are the distinct linked
    ids, A's times 2^32 plus B's, and ``times`` how many links of the document hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = GroupText()
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            (a, n_a), (b, n_b), (i, links), (j, _), (cut_a, cuts), (cut_b, _) = map(_flat, batch.columns[1:])
            doc = np.repeat(np.arange(n), links)
            # document, A id and B id in one number each: a plain sort puts equal ones together
            bits = int(max(a.max(initial=0), b.max(initial=0))).bit_length()
            keys = (doc << bits | a[i + (np.cumsum(n_a) - n_a)[doc]]) << bits | b[j + (np.cumsum(n_b) - n_b)[doc]]
            keys.sort()
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            times, keys = np.diff(np.append(new, len(keys))), keys[new]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys >> 2 * bits, minlength=n))]), pa.int32())
            low = (1 << bits) - 1
            pairs, times = pa.ListArray.from_arrays(ends, pa.array((keys >> bits & low) << 32 | keys & low)), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))
            digests = text.digests(a, n_a, b, n_b, cut_a, cut_b, cuts)
            columns = [batch.column(0), *map(pa.array, (n_a, n_b, cuts, links)), pa.array(digests, pa.string()), pairs, times]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = alignments.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return alignments.select("doc_id", *ALIGNED).mapInArrow(run, schema)


def pair_counts(summed: DataFrame) -> DataFrame:
    """``pair, count, best`` over all documents: how many links hold the pair of ids, and whether that is the most that the
    pair's B id has (ties included). Summed within tasks first. B ids are no more than the vocabulary, so their maxima may go
    to all tasks."""
    counted = summed.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    counted = staged(counted.withColumn("b", F.col("pair").bitwiseAND(2**32 - 1)), "pairs")
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return counted.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def document_scores(summed: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` for the rows of ``summed(row, pairs, times)`` that have links.

    Pairs of the highest counts, at most ``most_pairs``, are broadcast; the count from which on is a power of two, read
    off a histogram. The other pairs, which are below it, are joined by pair.
    """
    by_power = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()
    least, room = 63, most_pairs
    for power, n in sorted(map(tuple, by_power), reverse=True):
        room -= n
        if room < 0:
            break
        least = power
    links = summed.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")))
    frequent = F.col("count") >= min(2**least, 2**63 - 1)
    head = counts.where(frequent)

    def summed_up(rows: DataFrame) -> DataFrame:
        return rows.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))

    scored = summed_up(links.join(F.broadcast(head), "pair"))
    if room < 0:
        rare = links.join(F.broadcast(head.select("pair")), "pair", "left_anti")
        scored = scored.unionByName(summed_up(rare.join(counts.where(~frequent), "pair")))
    return scored.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def compare(alignments: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """A row for each row of ``align``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A link's count is how many links of all rows hold its pair of ids; ``n_best`` are the links of which no other A id
    has a higher count with their B id. Rows without tokens have zeros and an empty digest.
    """
    summed = staged(summaries(alignments).withColumn("row", F.monotonically_increasing_id()), "summaries")
    counts = staged(pair_counts(summed), "counts")
    scored = document_scores(summed, counts, most_pairs).withColumnRenamed("row", "scored")
    zero = F.lit(0).cast("long")
    joined = summed.join(scored, F.col("row") == F.col("scored"), "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
