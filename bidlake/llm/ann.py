"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by pseudo-rotations (random signs and a fast Hadamard transform, three times) and hashed to
the nearest signed axis; a few such hashes name a bucket of a table. A query probes every bucket whose axes it is
nearly as near to as to its best ones: by how much less at most, the reach, is measured, not set. The true neighbours of a
bounded sample of queries, found by an exact scan, say in which reach their buckets lie. What a query meets is ranked by
exact distances of the original vectors. Both sides are dealt by cells, groups of buckets, and only the nearest few of
a cell leave it, so no candidate pairs are shuffled. Queries that meet too few double their reach until they do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import staged
from bidlake.llm.vectors import from_wire, matrices, unit, usable, wire

#: Hash tables; more need fewer probes each, but the vectors are dealt once for each table.
TABLES = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def rotated(x: np.ndarray, table: int, which: int) -> np.ndarray:
    """Signed axes' coordinates (first the positive ones) of ``x``, whose width is a power of 2."""
    rng = np.random.default_rng([table, which, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return np.concatenate([x, -x], axis=1)


def padded(x: np.ndarray) -> np.ndarray:
    """Unit vectors, filled up with zeros to a power of 2."""
    return np.pad(unit(x), ((0, 0), (0, (1 << (x.shape[1] - 1).bit_length()) - x.shape[1])))


def axes_of(x: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """The nearest signed axis of each row by each hash of a table."""
    return np.stack([rotated(x, table, w).argmax(axis=1) for w in range(hashes)], axis=1)


def grid_of(n: int, width: int, hashes: int, cell: int) -> tuple[int, ...]:
    """Into how many groups each hash's axes fall, so that cells, which combine the groups, have about ``cell`` vectors."""
    grid, need = [], max(1, -(-n // cell))
    for w in range(hashes):
        grid.append(min(width, max(1, math.ceil(need ** (1 / (hashes - w)) - 1e-9))))
        need = -(-need // grid[-1])
    return tuple(grid)


def _index(classes: DataFrame, hashes: int, grids: dict[int, tuple[int, ...]], kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, v in matrices(b.column(1)):
                x, raw = padded(v), pa.array([r.tobytes() for r in v.astype(kind)], pa.binary())
                ids, full = b.column(0).take(pa.array(rows)), lambda value, n=len(rows): pa.array(np.full(n, value, dtype=np.int32))
                for t in range(TABLES):
                    axes, grid = axes_of(x, t, hashes), grids[dim]
                    cell = np.zeros(len(axes), dtype=np.int32)
                    for w, g in enumerate(grid):
                        cell = cell * g + (axes[:, w] % g).astype(np.int32)
                    columns = [ids, raw, full(t), full(dim), pa.array(cell), pa.array([a.tobytes() for a in axes.astype("<u2")], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["class_id", "v", "tab", "dim", "cell", "axes"])

    return classes.select("class_id", "v").mapInArrow(run, "class_id long, v binary, tab int, dim int, cell int, axes binary")


def _asked(queries: DataFrame, hashes: int, grids: dict[int, tuple[int, ...]], reach: float, kind: str) -> DataFrame:
    """The cells of each table in which a query's reach holds a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, v in matrices(b.column(1)):
                if dim not in grids:
                    continue
                x, raw, ids, grid = padded(v), [r.tobytes() for r in v.astype(kind)], b.column(0).take(pa.array(rows)), grids[dim]
                for t in range(TABLES):
                    r = [rotated(x, t, w) for w in range(hashes)]
                    best = sum(y.max(axis=1) for y in r)
                    top = [np.stack([y[:, g::n].max(axis=1) for g in range(n)], axis=1) for y, n in zip(r, grid, strict=True)]
                    for cell, groups in enumerate(product(*map(range, grid))):
                        at = np.flatnonzero(sum(m[:, g] for m, g in zip(top, groups, strict=True)) >= best - reach)
                        if len(at):
                            full = lambda value, n=len(at): pa.array(np.full(n, value, dtype=np.int32))
                            columns = [ids.take(pa.array(at)), pa.array([raw[i] for i in at], pa.binary()), full(t), full(dim), full(cell)]
                            yield pa.RecordBatch.from_arrays(columns, ["qid", "qv", "tab", "dim", "cell"])

    return queries.select("qid", "v").mapInArrow(run, "qid long, qv binary, tab int, dim int, cell int")


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _ranked(ids: np.ndarray, x: np.ndarray, q: np.ndarray, allowed: np.ndarray | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``q`` its number, and ids and distances of the ``k`` nearest rows of ``x`` allowed to it, ties to smaller ids. A
    product of matrices leaves those that may be among them, which are measured as they are."""
    size = (x**2).sum(axis=1)
    rough = size[None, :] - 2 * (q @ x.T) + (q**2).sum(axis=1)[:, None]
    slack = 1e-9 * (size.max(initial=0.0) + (q**2).sum(axis=1))
    if allowed is not None:
        rough[~allowed] = np.inf
    for i in range(len(q)):
        d = rough[i]
        limit = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        at = np.flatnonzero((d <= limit + slack[i]) & (d < np.inf))
        exact = distances(q[i], x[at])
        order = np.lexsort((ids[at], exact))[:k]
        yield i, ids[at[order]], exact[order]


def _found(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    parts = list(zip(*rows, strict=True)) or [[np.empty(0)]] * 3
    q, c, s = (np.concatenate(p) for p in parts)
    return pa.table({"qid": pa.array(q.astype(np.int64)), "class_id": pa.array(c.astype(np.int64)), "score": pa.array(s.astype(np.float64))})


def _meet(index: pa.Table, asked: pa.Table, hashes: int, reach: float, k: int, kind: str, block: int = 256) -> pa.Table:
    rows = []
    if len(index) and len(asked):
        table, x, ids = index["tab"][0].as_py(), from_wire(index["v"], kind), index["class_id"].to_numpy()
        buckets, back = np.unique(from_bytes(index["axes"], "<u2"), axis=0, return_inverse=True)
        q, qid = from_wire(asked["qv"], kind), asked["qid"].to_numpy()
        for lo in range(0, len(q), block):
            own, y = q[lo : lo + block], padded(q[lo : lo + block])
            r = [rotated(y, table, w) for w in range(hashes)]
            score = sum(m[:, buckets[:, w]] for w, m in enumerate(r))
            probed = score >= sum(m.max(axis=1) for m in r)[:, None] - reach
            rows += [(np.full(len(c), qid[lo + i]), c, s) for i, c, s in _ranked(ids, x, own, probed[:, back.ravel()], k)]
    return _found(rows)


def _meeting(hashes: int, reach: float, k: int, kind: str):
    return lambda index, asked: _meet(index, asked, hashes, reach, k, kind)


def from_bytes(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


def _exact(classes: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """Exact nearest classes of a bounded number of queries, with their vectors: ``qid, class_id, score, v``."""
    sent = classes.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for dim, rows, x in matrices(b.column(1)):
                own = [(qid, v) for qid, v in sent.value if len(v) == dim]
                if own:
                    near = _ranked(ids[rows], x, np.stack([v for _, v in own]), None, k)
                    yield _found([(np.full(len(c), own[i][0]), c, s) for i, c, s in near]).combine_chunks().to_batches()[0]

    found = classes.select("class_id", "v").mapInArrow(run, "qid long, class_id long, score double")
    return _top(found, k).join(classes.select("class_id", "v"), "class_id")


def _top(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("qid", "class_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("score", "class_id"))
    return one.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def measured_reach(classes: DataFrame, queries: DataFrame, hashes: int, k: int, recall: float, sample: int) -> float:
    """The least reach in which the share ``recall`` of the true neighbours of a sample of queries lies in some table."""
    some = queries.orderBy(F.xxhash64("qid"), "qid").limit(sample).collect()
    own = {r["qid"]: np.array(r["v"], dtype=np.float64) for r in some}
    gaps = []
    for r in _exact(classes, list(own.items()), k).collect():  # k rows for each query of the sample
        if r["class_id"] != r["qid"]:
            q, x = padded(own[r["qid"]][None]), padded(np.array([r["v"]], dtype=np.float64))
            gap = []
            for t in range(TABLES):
                each = [rotated(q, t, w)[0] for w in range(hashes)]
                axes = axes_of(x, t, hashes)[0]
                gap.append(sum(y.max() - y[a] for y, a in zip(each, axes, strict=True)))
            gaps.append(min(gap))
    return float(np.quantile(gaps, recall)) + 1e-9 if gaps else 0.0


def search(vectors: DataFrame, is_query: Column, k: int = 10, cell: int = 8000, recall: float = 0.97, sample: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row of ``vectors(vec_id, embedding, ...)`` where ``is_query`` holds the
    ``k`` nearest other rows found, by Euclidean distance in double precision, ties to smaller ids.

    Vectors that are null, zero or hold null or non-finite components, and rows of a null vec_id, take no part;
    vectors of different lengths are not compared. Equal vectors are hashed once and each class keeps its k + 1
    smallest ids, which is all that a query can return. Rows that share a vec_id are one another's own row and so no
    candidates of each other. No rows: no rows.

    ``recall`` is the share of the true neighbours of ``sample`` queries (those with the least hashes) that the probed
    buckets must hold; how far queries probe follows from it, on any data and at any size. A query that meets fewer than
    ``k`` others doubles its reach, in the end to all buckets, which is exact.
    """
    kind = wire(vectors, "embedding")
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = staged(good, "vectors")
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = good.select("v", "vec_id").distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    classes = staged(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("class_id")), "classes")
    queries = staged(good.where("is_query").groupBy("v").agg(F.min("vec_id").alias("qid")), "queries")
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a width
    if not sizes:
        return classes.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"))
    n = max(sizes.values())
    width = 2 << (max(sizes, key=sizes.get) - 1).bit_length()
    hashes = max(1, round(math.log(max(2, n)) / math.log(width)))
    grids = {d: grid_of(m, 2 << (d - 1).bit_length(), hashes, cell) for d, m in sizes.items()}
    reach = measured_reach(classes, queries.join(classes.select("class_id", "ids"), queries["qid"] == F.col("class_id"), "left").select("qid", "v"), hashes, k + 1, recall, sample)
    at = ["tab", "dim", "cell"]
    index = staged(_index(classes, hashes, grids, kind), "index")
    hot = index.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > 4 * cell)
    hot = staged(hot.select(*at, F.ceil(F.col("n") / cell).cast("int").alias("chunks")), "hot")
    chunks = F.coalesce("chunks", F.lit(1))
    dealt = index.join(hot, at, "left").withColumn("chunk", F.pmod(F.xxhash64("class_id"), chunks).cast("int")).drop("chunks")
    ids = classes.select("class_id", "ids")
    near, open_ = None, queries
    while True:
        asked = _asked(open_, hashes, grids, reach, kind).join(hot, at, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
        own = [*at, "chunk"]
        met = dealt.groupBy(*own).cogroup(asked.groupBy(*own)).applyInArrow(_meeting(hashes, reach, k + 1, kind), "qid long, class_id long, score double")
        top = staged(_top(met, k + 1), "near")
        held = top.join(ids, "class_id").groupBy("qid").agg(F.sum(F.size("ids")).alias("n"))
        open_ = staged(open_.join(held.where(F.col("n") > k), "qid", "left_anti"), "open")
        last = reach >= 2 * hashes or open_.isEmpty()
        done = top if last else top.join(open_.select("qid"), "qid", "left_anti")
        near = done if near is None else near.unionByName(done)
        if last:
            break
        reach = min(2.0 * hashes, max(0.1, 2 * reach))
    each = near.join(ids, "class_id").select("qid", "score", F.explode("ids").alias("vec_id"))
    some = each.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
    asked = good.where("is_query").select("v", F.col("vec_id").alias("query_id")).distinct().join(queries, "v").select("qid", "query_id")
    mine = some.join(asked, "qid").where("vec_id <> query_id")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return mine.withColumn("rank", r).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
