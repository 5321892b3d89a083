"""Near copies of texts by word shingles: candidates from SimHash and MinHash bands, verified by Jaccard similarity.

Two texts of similarity 0.8 differ in about 10 of 64 SimHash bits, far beyond what an index of shared fingerprint
positions can promise without pairing unrelated texts. So the index lists texts under bands of MinHash values as well:
20 bands of 5 rows, of which texts of similarity 0.8 miss all with probability (1 - 0.8^5)^20 = 0.0004. Every candidate
is verified by the true similarity of its shingle sets. Texts of one shingle set are one node from the start.

Only groups are sought. So the members of a list are first compared with one leader; in a list of near copies that
links most of them, at a comparison a member. Lists whose other members are then still of several groups are compared
among these, inside a task, by products of their members' shingle matrices; members of one group are not compared again,
and pairs leave the task only if they link. Shingle sets are larger than the texts they are from, so they are made and
written for the texts that meet any other, not for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm import simhash
from bidlake.llm.common import MOST_SENT, fresh, numbered, one_of_each, small_batches, staged
from bidlake.llm.graph import components

BANDS, ROWS = 20, 5
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; none if it has no words."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def _short(hashes: np.ndarray) -> np.ndarray:
    """A set of hashes, cut to 32 bits each."""
    return np.unique(hashes.astype(np.uint32))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of MinHash values of a set; no keys for the empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, (_A * hashes[None, at : at + 1024] + _B).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(band.tobytes(), n) - (1 << 63) for n, band in enumerate(low.reshape(BANDS, ROWS))]


def _profiles(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, digest, n, fp, keys`` for each row of ``texts(node, text)``; ``n`` is the size of its shingle set as ``_sets`` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, fps, keys = [], [], [], []
            for x in b.column(1):
                hashes = simhash.shingle_hashes(x.as_py(), shingle)
                own = np.unique(hashes)
                digests.append(xxhash.xxh128_digest(own.tobytes()))
                sizes.append(len(_short(own)))
                fps.append(simhash.bits_of(hashes))
                keys.append(band_keys(own))
            columns = [b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "digest", "n", "fp", "keys"])

    return texts.mapInArrow(run, "node long, digest binary, n int, fp long, keys array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, s`` for each row of ``texts(node, text)``: its shingle set, cut to 32 bits a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_short(shingle_set(x.as_py(), shingle)).view(np.int32) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int32()))], ["node", "s"])

    return texts.mapInArrow(run, "node long, s array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of which ``sets(node, s)`` says that they have at least this Jaccard similarity."""
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared / (F.size("sa") + F.size("sb") - shared) >= similarity).select("a", "b")


def _ordered(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a < b`` of ``met(node, n, other, m)`` whose sizes allow the similarity, each once."""
    may = met.where((F.col("node") != F.col("other")) & (F.least("n", "m") / F.greatest("n", "m") >= similarity))
    return may.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def shared_shingles(a: list[np.ndarray], b: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """How many members each set of ``a`` shares with each of ``b``, by products of their 0-1 matrices, a block of members at a time."""
    flat = np.concatenate([*a, *b])
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    several = held > 1  # what one set alone has, no pair shares
    rows, column = rows[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for lo in range(0, int(several.sum()), block):
        own = slice(*np.searchsorted(column, [lo, lo + block]))
        m = np.zeros((len(a) + len(b), block), dtype=np.float32)
        m[rows[own], column[own] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _compared(group: pa.Table, similarity: float) -> pa.Table:
    """The pairs ``a, b`` of a list's nodes, or of two chunks of it, that are of different roots and similar."""
    node, root, left, right = (group[c].to_numpy(zero_copy_only=False) for c in ("node", "root", "left", "right"))
    sets = [np.asarray(x.values) for x in group["s"]]
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    shared = shared_shingles([sets[i] for i in a], [sets[i] for i in b])
    n = np.array([len(x) for x in sets], dtype=np.float64)
    alike = shared >= similarity * (n[a][:, None] + n[b][None, :] - shared) - 1e-9
    i, j = np.nonzero(alike & (root[a][:, None] != root[b][None, :]) & (node[a][:, None] != node[b][None, :]))
    low, high = np.minimum(node[a[i]], node[b[j]]), np.maximum(node[a[i]], node[b[j]])
    return pa.table({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})


def _in_chunks(members: DataFrame, most: int) -> DataFrame:
    """Deal ``members(key, node, root)`` of lists to groups ``(key, pair)`` of at most two chunks of about ``most``, with the sides ``left`` and
    ``right`` that each is on. A root with more members than that in a list has chunks of its own, which do not meet each other."""
    size = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    parts = size.groupBy("key", F.when(F.col("n") > most, F.col("root")).otherwise(-1).alias("part")).agg(F.ceil(F.sum("n") / most).cast("int").alias("chunks"))
    several = parts.groupBy("key").agg(F.sum("chunks").alias("of")).where("of > 1")
    parts = staged(parts.join(several, "key").select("key", "part", "chunks"), "parts")
    both = F.lit(True)
    if parts.isEmpty():
        return members.withColumns({"pair": F.lit("all"), "left": both, "right": both})
    whole = members.join(parts.select("key").distinct(), "key", "left_anti").withColumns({"pair": F.lit("all"), "left": both, "right": both})
    big = parts.where("part >= 0").select("key", F.col("part").alias("root"), F.col("part").alias("own"))
    m = members.join(parts.select("key").distinct(), "key", "left_semi").join(big, ["key", "root"], "left").withColumn("part", F.coalesce("own", F.lit(-1))).join(parts, ["key", "part"])
    m = m.withColumn("chunk", F.concat_ws("/", "part", F.pmod(F.xxhash64("node"), F.col("chunks")))).select("key", "node", "root", "part", "chunk")
    chunks = parts.select("key", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c")).select("key", "part", F.concat_ws("/", "part", "c").alias("chunk"))
    met = chunks.join(chunks.toDF("key", "other_part", "other"), "key").where("chunk <= other AND NOT (part = other_part AND part >= 0)")
    met = met.select("key", "chunk", "other", F.concat_ws("|", "chunk", "other").alias("pair"))
    first = m.join(met, ["key", "chunk"]).select("key", "node", "root", "pair", both.alias("left"), (F.col("chunk") == F.col("other")).alias("right"))
    second = m.withColumnRenamed("chunk", "other").join(met.where("chunk <> other"), ["key", "other"]).select("key", "node", "root", "pair", F.lit(False).alias("left"), both.alias("right"))
    return whole.unionByName(first).unionByName(second)


def _sent(few: DataFrame) -> DataFrame:
    """``few``, read from what is written, to be joined: broadcast, so that what it meets stays where it is, unless it has over ``MOST_SENT`` rows."""
    return F.broadcast(few) if few.count() <= MOST_SENT else few


def groups(nodes: DataFrame, texts: DataFrame, similarity: float, shingle: int = 5, lead: bool = True, most: int = 1000) -> DataFrame:
    """Components ``node, root`` of the links of at least this similarity among ``nodes(node, n, fp, keys)``, n > 0, whose
    texts are in ``texts(node, text)``, as ``graph.components`` gives them.

    All pairs that meet in a list are compared, but for those that the leaders' links (without ``lead``: SimHash alone) have
    united already. Leaders are the members whose lists are longest: the text that the others are copies of, as a rule.
    """
    fp = F.xxhash64(F.lit("fingerprint"), "fp")
    lists = staged(nodes.select("node", "n", F.explode(F.array_append("keys", fp)).alias("key")), "lists")
    sizes = staged(lists.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    lists = staged(lists.join(_sent(sizes), "key").select("key", "node", "n", "size"), "several")
    among = lists.select("key", "node")
    first = nodes.groupBy("fp").agg(F.min_by(F.struct("node", "n"), "node").alias("f")).select("fp", "f.node", "f.n")
    first = staged(first, "first")
    close = simhash.links(first.select("fp")).join(first.toDF("a", "node", "n"), "a").join(first.toDF("b", "other", "m"), "b").select("node", "n", "other", "m")
    if lead:
        weight = lists.groupBy("node").agg(F.sum("size").alias("weight"))
        leader = F.max_by(F.struct("node", "n"), F.struct("weight", -F.col("node"))).alias("l")
        leaders = lists.join(weight, "node").groupBy("key").agg(leader).select("key", F.col("l.node").alias("other"), F.col("l.n").alias("m"))
        led = staged(lists.join(leaders, "key").select("key", "node", "n", "other", "m"), "led")
        close = close.unionByName(led.drop("key"))
        among = led.where("node <> other").select("key", "node")  # all pairs with a list's leader are verified
    pairs = staged(_ordered(close, similarity), "pairs")
    # only what meets anything is verified: its sets are made and written, once
    asked = staged(lists.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "asked")
    sets = staged(_sets(texts.join(_sent(asked), "node", "left_semi").select("node", "text"), shingle), "sets")
    edges = staged(_verified(pairs, sets, similarity), "links")
    hung = components(edges).toDF("hung", "root")
    members = among.join(hung, F.col("node") == F.col("hung"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    left = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = staged(members.join(left, "key", "left_semi"), "left")
    if left.isEmpty():
        return hung.toDF("node", "root")
    dealt = _in_chunks(left, most).join(sets, "node").select("key", "pair", "node", "root", "left", "right", "s")
    found = dealt.groupBy("key", "pair").applyInArrow(lambda g: _compared(g, similarity), "a long, b long").distinct()
    return components(edges.unionByName(staged(found, "found")))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, lead: bool = True, most: int = 1000) -> DataFrame:
    """One row of each group of near copies of ``docs(doc_id, text, ...)``, in the columns of ``docs``: that with the
    smallest id, null ids last. Groups are the components of links of at least ``similarity`` between the sets of word
    shingles; fewer words than a shingle are one shingle, and texts without words are copies of each other."""
    small_batches(docs.sparkSession)
    (row,) = fresh(docs, "row_number")
    rows = numbered(docs, row)
    texts = rows.select(F.col(row).alias("node"), "text")
    own = staged(_profiles(texts, shingle), "profiles")
    classes = staged(own.groupBy("digest").agg(F.min("node").alias("node"), F.count("*").alias("rows")), "classes")
    several = classes.where("rows > 1").select("digest", F.col("node").alias("first"))
    copies = staged(own.select("node", "digest").join(_sent(several), "digest").where("node <> first").select("node"), "copies")
    nodes = staged(own.where("n > 0").drop("digest").join(_sent(copies), "node", "left_anti"), "nodes")
    hung = groups(nodes, texts, similarity, shingle, lead, most).toDF("hung", "root")
    rooted = classes.join(hung, F.col("node") == F.col("hung"), "left").select("digest", F.coalesce("root", "node").alias("root"))
    return one_of_each(rows, row, own.join(rooted, "digest").select("node", "root"))
