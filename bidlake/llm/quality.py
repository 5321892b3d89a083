"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairs in linear time by the sum-of-squares
identity: half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2. It is fitted by AdaGrad on a bounded sample of labelled rows;
every document is scored on the executors.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import fresh, once, small_batches

WORD_BITS, RANK, BINS = 15, 8, 16
#: Structure statistics and metadata, each cut into BINS intervals (a feature each) behind the hashed words.
STATISTICS = ("symbols", "capitals", "digits", "distinct_words", "word_length", "top_word", "distinct_lines", "line_length", "pipes", "marks_in_words", "length")
FEATURES = (1 << WORD_BITS) + len(STATISTICS) * BINS


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Each from 0 to 1. The last, the length, is the one piece of metadata that says nothing of a document's origin."""
    n, w = max(1, len(text)), max(1, len(words))
    letters = sum(map(len, words)) or 1
    alpha = sum(map(str.isalpha, words))
    lines = text.split("\n")
    upper = sum(1 for x in words if x.isupper())
    digits = sum(map(text.count, "0123456789"))
    marks = sum(map(text.count, "#$%&*!^~<>{}[]=+\\|@"))
    return [
        min(1.0, marks / n * 8),
        upper / w,
        min(1.0, digits / n * 8),
        len(counts) / w,
        min(1.0, letters / w / 16),
        (max(counts.values()) if counts else 0) / w,
        len(set(lines)) / len(lines),
        min(1.0, math.log2(1 + n / len(lines)) / 12),
        min(1.0, text.count("|") / w * 2),
        1 - alpha / w,
        min(1.0, math.log2(1 + n) / 20),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text; null is empty."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    mask = (1 << WORD_BITS) - 1
    ids = np.fromiter((zlib.crc32(x.lower().encode()) & mask for x in counts), dtype=np.int32, count=len(counts))
    x = np.log1p(np.fromiter(counts.values(), dtype=np.float32, count=len(counts)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    stats = [(1 << WORD_BITS) + i * BINS + min(BINS - 1, int(v * BINS)) for i, v in enumerate(statistics(text, words, counts))]
    return np.concatenate([ids, np.array(stats, dtype=np.int32)]), np.concatenate([x, np.full(len(stats), 0.5, dtype=np.float32)])


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, ids: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[ids] * x[:, None]
        s = vx.sum(0)
        return float(self.bias + self.w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(ids, x)))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 1) -> FactorisationMachine:
    """AdaGrad on the log loss. Without rows of both labels, the constant score of the share of label 1 (0.5 if none)."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    m = FactorisationMachine(math.log(share / (1 - share)), np.zeros(FEATURES, np.float32), rng.normal(0, 0.01, (FEATURES, RANK)).astype(np.float32))
    if len(set(y.tolist())) < 2:
        return FactorisationMachine(m.bias, m.w, m.v * 0)
    gw, gv, gb = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            own = order[lo : lo + batch]
            ids, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            at = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
            starts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in own])[:-1]])
            vx = m.v[ids] * x[:, None]
            s = np.add.reduceat(vx, starts)
            z = m.bias + np.add.reduceat(m.w[ids] * x, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
            used, back = np.unique(ids, return_inverse=True)
            dw, dv = np.bincount(back, g[at] * x, len(used)), np.empty((len(used), RANK))
            each = (g[at] * x)[:, None] * (s[at] - vx)
            for f in range(RANK):
                dv[:, f] = np.bincount(back, each[:, f], len(used))
            dw, dv = dw + decay * m.w[used], dv + decay * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += float(g.sum()) ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.bias -= rate * float(g.sum()) / math.sqrt(gb)
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for testing only."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, **how: float) -> FactorisationMachine:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, quality)``, at most ``max_rows`` labelled documents: those
    with the least hashes of their ids. Rows held out, null ids and null labels are not used; of several labels of a
    document the mean counts, 1 from 0.5 on; of several texts the least."""
    y = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    some = y.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_rows)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [features(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype(str), "y": b["y"], "ids": [r[0] for r in rows], "x": [r[1] for r in rows]})

    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # max_rows ids; a text each before any leaves the executors
    sample = sample.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
    got = sample.mapInPandas(extract, "doc_id string, y int, ids array<int>, x array<float>").toPandas()
    got = got.assign(h=lambda d: [zlib.crc32(x.encode()) for x in d["doc_id"]]).sort_values(["h", "doc_id"])
    rows = [(np.asarray(i, np.int32), np.asarray(x, np.float32)) for i, x in zip(got["ids"], got["x"], strict=True)]
    return fit(rows, got["y"].to_numpy(np.float64), **how)


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """Add ``held_out, score, predicted`` to ``docs(doc_id, text, ...)``. Only the text is looked at: null counts as
    empty, and empty texts get the score of their statistics. Rows of one text score alike; an empty table stays
    empty. Columns with such names stay; the new ones then get underscores in front."""
    small_batches(docs.sparkSession)
    held, value, predicted = fresh(docs, "held_out", "score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x (RANK + 1) numbers, whatever the corpus

    @F.pandas_udf("double")
    def judge(text: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(*features(t)) for t in text], dtype=float)

    out = docs.withColumn(held, held_out(F.col("doc_id"))).withColumn(value, once(judge)("text"))
    return out.withColumn(predicted, (F.col(value) >= 0.5).cast("int"))
