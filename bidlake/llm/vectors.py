"""Embedding near-duplicates by a forest of random-projection trees with spill.

Each tree splits the vectors again and again by the median of a random projection; vectors near the median go to both
sides. How near follows from the cosine sought: a share of the spread that projecting two such vectors' difference
has. Every level spills, however deep: leaves that are too large are fitted anew on a sample of their own members, on
the executors, until all are small or so dense that a split would part too many close pairs. The number of trees grows
with their depth and with what splits part in a sample, so that the share of links that no tree finds stays below
``miss``. Vectors are compared within leaves only, in double precision, and found links are united.

Equal vectors are one node from the start. A large group of close vectors has a hub, a member of a bounded sample:
vectors within half of the angle sought of one hub all link with each other, so they are counted and not compared;
they leave the forest, and what may link with them from outside is compared with them directly.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.llm.common import staged
from bidlake.llm.graph import components

#: Sample points of a node that is split, planes tried for it, and the share of a node on one side that makes it dense.
POINTS, PLANES, DENSE = 64, 4, 0.85
#: Members that a hub has in the sample; bytes of a broadcast part of the forest, and of a chunk of vectors.
HUB_POINTS, PART_BYTES, CHUNK_BYTES = 16, 32 << 20, 16 << 20


def usable(v: Column) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector in the column: the length, the rows and their vectors in double precision."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, flat[starts[rows][:, None] + np.arange(dim)]


def wire(vectors: DataFrame, column: str) -> str:
    """How components travel as bytes: as they are stored, so nothing is rounded."""
    return "<f4" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "<f8"


def from_wire(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1).astype(np.float64)


def _mix(*numbers: int) -> int:
    return xxhash.xxh64_intdigest(b"".join(n.to_bytes(8, "little", signed=True) for n in numbers)) - (1 << 63)


def _planes(key: int, node: int, dim: int) -> np.ndarray:
    return np.random.default_rng([key % (1 << 64), node, dim]).standard_normal((PLANES, dim)) / math.sqrt(dim)


def _outside(spill: float) -> float:
    """The mean of how far a standard normal difference reaches over the spill on both sides."""
    m = 2 * spill
    return 2 * (math.exp(-m * m / 2) / math.sqrt(2 * math.pi) - m * (1 - math.erf(m / math.sqrt(2))) / 2)


def lost_at_a_split(cosine: float, spill: float) -> float:
    """The share of pairs at the cosine that a median split of evenly spread vectors parts in spite of the spill."""
    return math.sqrt((1 - cosine) / math.pi) * _outside(spill)


def trees_for(depth: float, lost: float, miss: float) -> tuple[int, float]:
    """Trees needed so that a pair at the cosine meets in none with a probability of at most ``miss``, if each level parts the
    share ``lost``; and the share that a path of a tree may part in all for that."""
    may = 1 - (1 - min(0.5, lost)) ** (depth + 1)
    return (1, 1.0) if depth <= 1 else (max(3, math.ceil(math.log(miss) / math.log(may))), may)


def fit_tree(key: int, x: np.ndarray, total: int, spent: float, may: float, cosine: float, leaf: int, spill: float) -> tuple[dict, set, dict, list]:
    """A tree for a leaf of ``total`` vectors, of which ``x`` is a sample: its nodes as ``number: (plane, low, high)``, its
    dense leaves, what its other leaves have spent and what each split parts. Node 1 is the root, node n has the children 2n
    and 2n + 1; a vector goes left up to ``high`` and right from ``low``.

    The share of close pairs that a split parts follows from how many vectors lie near its plane. A node is dense, and
    stays whole, where a split would send nearly everything to both sides or its path would part more than it ``may``."""
    dim, nodes, dense, ends, parts = x.shape[1], {}, set(), {}, []
    scale = math.sqrt(2 * (1 - cosine) / dim)
    margin = spill * scale
    todo = [(1, np.arange(len(x)), spent)]
    while todo:
        node, own, spent = todo.pop()
        if node > 1 and (len(own) * total / len(x) <= leaf or len(own) < POINTS):
            ends[node] = spent
            continue
        p = x[own] @ _planes(key, node, dim).T
        middle = np.median(p, axis=0)
        left, right = p <= middle + margin, p >= middle - margin
        best = int(np.argmin(left.sum(0) + right.sum(0)))
        both = left[:, best].sum() + right[:, best].sum() - len(own)
        lost = min(1.0, both / len(own) / (2 * spill) * _outside(spill))
        if max(left[:, best].sum(), right[:, best].sum()) > DENSE * len(own) or 1 - (1 - spent) * (1 - lost) > may:
            dense.add(node)
            continue
        parts.append(lost)
        nodes[node] = (best, middle[best] - margin, middle[best] + margin)
        todo += [(2 * node, own[left[:, best]], 1 - (1 - spent) * (1 - lost)), (2 * node + 1, own[right[:, best]], 1 - (1 - spent) * (1 - lost))]
    return nodes, dense, ends, parts


def measured_loss(x: np.ndarray, cosine: float, spill: float) -> float:
    """What a split of the sample ``x`` parts in the mean over the nodes of a trial tree."""
    parts = fit_tree(0, x, len(x), 0.0, 1.0, cosine, POINTS, spill)[3]
    return float(np.mean(parts)) if parts else 0.0


def _leaf_key(key: int, node: int, dense: bool) -> int:
    """Keys of dense leaves are odd, all others even."""
    return _mix(key, node) & ~1 | dense


def leaves(key: int, x: np.ndarray, nodes: dict, dense: set) -> Iterator[tuple[int, np.ndarray]]:
    """``(key of a leaf, rows of x)``."""
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node not in nodes:
            yield _leaf_key(key, node, node in dense), own
            continue
        plane, low, high = nodes[node]
        p = x[own] @ _planes(key, node, x.shape[1])[plane]
        todo += [(2 * node, own[p <= high]), (2 * node + 1, own[p >= low])]


def find_hubs(x: np.ndarray, cosine: float) -> np.ndarray:
    """Of the unit vectors ``x`` those that have enough others within half of the angle, none of them within another's."""
    near = x @ x.T >= math.sqrt((1 + cosine) / 2) + 1e-9
    hubs = []
    while len(x):
        counts = near.sum(1)
        best = int(counts.argmax())
        if counts[best] < HUB_POINTS:
            break
        hubs.append(best)
        gone = near[best].copy()
        near[gone] = False
        near[:, gone] = False
    return x[hubs]


_ROW = "class_id long, n long, v binary, dim int, hub int, visits array<int>, keys array<long>"


def _placed(classes: DataFrame, hubs: dict[int, np.ndarray], cosine: float, trees: int, kind: str) -> DataFrame:
    """A row of ``_ROW`` for each class: its hub or -1, the other hubs whose members may link with it, each pair of
    hubs once, and the roots of its trees (none if it has a hub)."""
    sent = classes.sparkSession.sparkContext.broadcast(hubs)  # at most a sixteenth of the sample
    within = math.sqrt((1 + cosine) / 2) + 1e-9
    reach = math.cos(1.5 * math.acos(max(-1.0, min(1.0, cosine)))) - 1e-9 if cosine > -0.5 else -2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, rows, x in matrices(b.column(2)):
                at = pa.array(rows)
                own, visits = np.full(len(rows), -1, dtype=np.int32), [[]] * len(rows)
                if dim in sent.value:
                    near = unit(x) @ sent.value[dim].T
                    best = near.argmax(axis=1)
                    inside = near[np.arange(len(rows)), best] >= within
                    own[inside] = best[inside]
                    # of two hubs' members those of the later one visit the earlier one's
                    seen = (near >= reach) & ((own < 0)[:, None] | (np.arange(near.shape[1])[None, :] < own[:, None]))
                    visits = [np.flatnonzero(s).astype(np.int32) for s in seen]
                roots = [_mix(t, dim) & ~1 for t in range(trees)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(at),
                        b.column(1).take(at),
                        pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
                        pa.array(np.full(len(rows), dim, dtype=np.int32)),
                        pa.array(own),
                        pa.array(visits, pa.list_(pa.int32())),
                        pa.array([[] if h >= 0 else roots for h in own], pa.list_(pa.int64())),
                    ],
                    ["class_id", "n", "v", "dim", "hub", "visits", "keys"],
                )

    return classes.select("class_id", "n", "v").mapInArrow(run, _ROW)


def _fitted(rows: DataFrame, large: DataFrame, how: tuple[float, float, int, float], sample: int, kind: str) -> DataFrame:
    """``key, model, ends``: a tree for each leaf of ``large(key, size, spent)``, fitted on about ``sample`` of its members, and what
    its own leaves have spent."""
    share = (F.lit(float(sample)) / F.col("size") - 0.5) * F.lit(2.0**64)
    some = rows.select("class_id", "v", F.explode("keys").alias("key")).join(large, "key").where(F.xxhash64("class_id", "key").cast("double") < share)

    def fit(group: pa.Table) -> pa.Table:
        key, total, spent = (group[c][0].as_py() for c in ("key", "size", "spent"))
        nodes, dense, ends, _ = fit_tree(key, unit(from_wire(group["v"], kind)), total, spent, *how)
        ends = [{"key": _leaf_key(key, node, False), "spent": s} for node, s in ends.items()]
        kinds = pa.list_(pa.struct([("key", pa.int64()), ("spent", pa.float64())]))
        return pa.table({"key": pa.array([key], pa.int64()), "model": pa.array([pickle.dumps((nodes, dense))], pa.binary()), "ends": pa.array([ends], kinds)})

    return some.select("key", "size", "spent", "v").groupBy("key").applyInArrow(fit, "key long, model binary, ends array<struct<key:long,spent:double>>")


def _routed(rows: DataFrame, models: dict[int, tuple[dict, set]], kind: str) -> DataFrame:
    """``rows`` with each key that has a tree replaced by its leaves' keys."""
    sent = rows.sparkSession.sparkContext.broadcast(models)  # about PART_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(6)
            keys, at = column.flatten().to_numpy(), np.repeat(np.arange(len(b)), column.value_lengths().to_numpy(zero_copy_only=False))
            names, back = np.unique(keys, return_inverse=True)
            mine = np.array([int(k) in sent.value for k in names], dtype=bool)
            new_at, new_keys = [at[~mine[back]]] if len(names) else [], [keys[~mine[back]]] if len(names) else []
            vs = b.column(2).to_pylist()
            for k in np.flatnonzero(mine):
                own = at[back == k]
                x = unit(np.frombuffer(b"".join(vs[i] for i in own), dtype=kind).reshape(len(own), -1).astype(np.float64))
                for leaf, members in leaves(int(names[k]), x, *sent.value[int(names[k])]):
                    new_at.append(own[members])
                    new_keys.append(np.full(len(members), leaf, dtype=np.int64))
            at = np.concatenate(new_at) if new_at else np.empty(0, dtype=np.int64)
            order = np.argsort(at, kind="stable")
            values = (np.concatenate(new_keys) if new_keys else np.empty(0, dtype=np.int64))[order]
            ends = np.searchsorted(at[order], np.arange(len(b) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], b.schema.names)

    return rows.mapInArrow(run, _ROW)


def forest(rows: DataFrame, how: tuple[float, float, int, float], sample: int, kind: str) -> DataFrame:
    """``rows`` of ``_ROW`` routed to leaves of at most twice ``leaf`` members, or dense ones; ``how`` is ``(may, cosine, leaf, spill)``.
    Each round fits trees for the leaves that are too large; what is broadcast at once is a part of them of bounded size."""
    spent = None
    while True:
        sizes = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("size"))
        large = sizes.where((F.col("size") > 2 * how[2]) & (F.col("key").bitwiseAND(F.lit(1)) == 0))
        large = staged(large.withColumn("spent", F.lit(0.0)) if spent is None else large.join(spent, "key"), "large")
        if large.isEmpty():
            return rows
        models = staged(_fitted(rows, large, how, sample, kind), "models")
        spent = models.select(F.inline("ends"))
        parts = math.ceil(models.agg(F.sum(F.length("model"))).first()[0] / PART_BYTES)
        for part in range(parts):
            own = models.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).select("key", "model").collect()
            # written before the next part is sent, so that workers hold one part at a time
            rows = staged(_routed(rows, {r["key"]: pickle.loads(r["model"]) for r in own}, kind), "routed")


def _near(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of ``a`` and ``b`` of at least this cosine. Single precision decides where it is clear."""
    s = a.astype(np.float32) @ b.astype(np.float32).T
    doubt = max(1e-5, 2e-7 * a.shape[1])
    i, j = np.nonzero(s >= cosine - doubt)
    close = np.flatnonzero(s[i, j] < cosine + doubt)
    keep = np.ones(len(i), dtype=bool)
    keep[close] = np.einsum("ij,ij->i", a[i[close]], b[j[close]]) >= cosine
    return i[keep], j[keep]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of all pairs the smallest label that they are connected with."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def _compare(group: pa.Table, cosine: float, kind: str, block: int = 256) -> pa.Table:
    """Links in a leaf (or between two chunks of one): of each vector the number of others linked for the first time
    here, and the smallest one of those connected here."""
    key, i, j = (group[c][0].as_py() for c in ("key", "i", "j"))
    x = unit(from_wire(group["v"], kind))
    n, ids, chunk = (group[c].to_numpy() for c in ("n", "class_id", "chunk"))
    # leaves are ordered by their key; a link is counted in the first leaf that both are in
    keys = group["keys"].combine_chunks()
    flat = keys.flatten().to_numpy()
    at = np.repeat(np.arange(len(x)), keys.value_lengths().to_numpy(zero_copy_only=False))[flat < key]
    names, column, held = np.unique(flat[flat < key], return_inverse=True, return_counts=True)
    several = held > 1  # what one vector alone is in, no pair shares
    earlier = np.zeros((len(x), int(several.sum())), dtype=bool)
    shared = several[column]
    earlier[at[shared], (np.cumsum(several) - 1)[column[shared]]] = True
    earlier = np.packbits(earlier, axis=1)
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    links, label, linked = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), np.zeros(len(x), dtype=bool)
    for lo in range(0, len(left), block):
        own = left[lo : lo + block]
        others = right[right > own[0]] if i == j else right
        a, b = _near(x[own], x[others], cosine)
        a, b = own[a], others[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        new = ~(earlier[a] & earlier[b]).any(axis=1)
        links += np.bincount(a[new], n[b[new]], len(x)).astype(np.int64) + np.bincount(b[new], n[a[new]], len(x)).astype(np.int64)
        linked[a] = linked[b] = True
        _unite(label, a, b)
    ok = np.flatnonzero(linked)
    low = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    return pa.table({"class_id": pa.array(ids[ok], pa.int64()), "links": pa.array(links[ok], pa.int64()), "other": pa.array(low[label[ok]], pa.int64())})


def _in_chunks(members: DataFrame, most: int) -> DataFrame:
    """Deal the members of leaves beyond ``most`` to chunks: each pair of chunks of a leaf is a group ``(key, i, j)``."""
    large = members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most)
    large = staged(large.select("key", F.ceil(F.col("size") / most).cast("int").alias("chunks")), "dense")
    if large.isEmpty():
        return members.withColumns({c: F.lit(0) for c in ("chunk", "i", "j")})
    rows = members.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("class_id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("i", F.least("chunk", "o")).withColumn("j", F.greatest("chunk", "o")).drop("o", "chunks")


def _around_hubs(rows: DataFrame, most: int) -> DataFrame:
    """Members of hubs with the vectors from outside that may link with them, as groups ``(key, i, j)`` of a chunk of members
    and one of visitors."""
    no_keys = F.array().cast("array<long>").alias("keys")
    own = rows.where("hub >= 0").select("class_id", "n", "v", "dim", "hub")
    from_outside = rows.select("class_id", "n", "v", "dim", F.explode("visits").alias("hub"))
    at = ["dim", "hub"]
    sizes = own.groupBy(*at).agg(F.count("*").alias("m")).join(from_outside.groupBy(*at).agg(F.count("*").alias("o")), at)
    # one row a hub, at most a sixteenth of the sample
    sizes = F.broadcast(staged(sizes.select(*at, F.ceil(F.col("m") / most).cast("int").alias("m"), F.ceil(F.col("o") / most).cast("int").alias("o")), "hubs"))
    dealt = lambda parts: F.pmod(F.xxhash64("class_id"), F.col(parts)).cast("int")
    members = own.join(sizes, at).withColumn("i", dealt("m")).withColumn("j", F.explode(F.sequence(F.col("m"), F.col("m") + F.col("o") - 1))).withColumn("chunk", F.col("i"))
    visitors = from_outside.join(sizes, at).withColumn("j", F.col("m") + dealt("o")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("chunk", F.col("j"))
    columns = ["class_id", "n", "v", no_keys, F.xxhash64(*at).alias("key"), "chunk", "i", "j"]
    return members.select(*columns).unionByName(visitors.select(*columns))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, leaf: int = 3200, spill: float = 0.35, miss: float = 0.002, sample: int = 8192, hub_sample: int = 4096) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, ...)``.

    Vectors that are null, zero or hold null or non-finite components, and rows of a null vec_id, link with nothing
    and stand alone; vectors of different lengths are not compared. Equal vectors link. Rows that share a vec_id are
    vectors of their own. An empty table stays empty.

    ``leaf`` is the size sought for leaves; dense leaves stay larger and are compared in chunks. A tree is fitted on about
    ``sample`` vectors of the leaf that it splits, hubs on at most ``hub_sample`` distinct ones, those with the least hashes.
    ``miss`` bounds the modelled share of links at the cosine sought that no tree finds.
    """
    kind = wire(vectors, "embedding")
    ok = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    same = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    good = vectors.where(ok).select("vec_id", F.col("embedding").alias("v"))
    classes = good.groupBy(*same).agg(F.min(F.col("vec_id").cast("long")).alias("class_id"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = staged(classes, "classes")
    total = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, total["width"] or 1)
    leaf = max(16, min(leaf, CHUNK_BYTES // (4 * width)))
    some = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(min(hub_sample, max(256, (64 << 20) // (8 * width)))).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in some:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    samples = {dim: unit(np.array(vs, dtype=np.float64)) for dim, vs in by_dim.items()}
    hubs = {dim: h for dim, x in samples.items() if len(h := find_hubs(x, cosine))}
    lost = max([lost_at_a_split(cosine, spill), *(measured_loss(x, cosine, spill) for x in samples.values())])
    trees, may = trees_for(math.log2(max(1.0, total["n"] / leaf)), lost, miss)
    rows = staged(_placed(classes, hubs, cosine, trees, kind), "placed")
    rows = forest(rows, (may, cosine, leaf, spill), sample, kind)
    members = rows.where("hub < 0").select("class_id", "n", "v", "keys", F.explode("keys").alias("key"))
    groups = _in_chunks(members, 4 * leaf)
    if hubs:
        groups = groups.unionByName(_around_hubs(rows, 4 * leaf))
    groups = groups.select("key", "i", "j", "chunk", "class_id", "n", "v", "keys")
    found = groups.groupBy("key", "i", "j").applyInArrow(lambda g: _compare(g, cosine, kind), "class_id long, links long, other long")
    found = staged(found, "found")
    own = rows.select("class_id", "dim", "hub").where("hub >= 0")
    around = rows.where("hub >= 0").groupBy("dim", "hub").agg(F.sum("n").alias("around"), F.min("class_id").alias("first"))
    around = staged(own.join(F.broadcast(around), ["dim", "hub"]).select(F.col("class_id").alias("member"), "around", "first"), "around")
    edges = found.select(F.col("class_id").alias("a"), F.col("other").alias("b")).unionByName(around.select("member", "first").toDF("a", "b"))
    hung = components(edges)
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    per = classes.select("h1", "h2", "class_id", "n").join(links, "class_id", "left").join(hung, F.col("class_id") == F.col("node"), "left")
    per = per.join(around, F.col("class_id") == F.col("member"), "left")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("around") - 1, F.col("n") - 1)
    per = per.select("h1", "h2", n_links.alias("n_links"), F.coalesce("root", "class_id").alias("component_id"))
    out = good.select("vec_id", *same).join(per, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
