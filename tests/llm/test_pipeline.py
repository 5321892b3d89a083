"""The pipeline's stages against brute force, each on what its predecessor kept, and the columns they return."""

import itertools
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm import mixing, nearcopies, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """The input of each stage and the last result, written and read again."""
    out, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs.toPandas())
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas()) if stage is not corpus_pipeline.pack else stage(spark, docs, sf_dir)
    return [*out, docs.toPandas()]


def test_columns(kept):
    assert len({tuple(d.columns) for d in kept[:-1]}) == 1 and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(len(d) for d in kept)


def test_classifier(spark, sf_dir, kept):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = {i for i, t in zip(kept[0]["doc_id"], kept[0]["text"]) if model.score(*quality.features(t)) >= 0.5}
    assert set(kept[1]["doc_id"]) == want
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, y in labels.items() if y == 1]
    assert sum(i in want for i in clean) >= 0.97 * len(clean)


def test_lines(kept):
    key = lambda x: x.strip(" \t\n\v\f\r").encode().lower().decode()
    held = Counter(k for t in kept[1]["text"] for k in {key(x) for x in t.split("\n")})
    want = {i: "\n".join(x for x in t.split("\n") if not key(x) or held[key(x)] < 10) for i, t in zip(kept[1]["doc_id"], kept[1]["text"])}
    want = {i: t for i, t in want.items() if WORD.search(t)}
    assert dict(zip(kept[2]["doc_id"], kept[2]["text"])) == want
    assert all(n == len(t) for n, t in zip(kept[2]["n_chars"], kept[2]["text"]))


def test_near_copies(kept):
    """Components of the links of similarity 0.8 or more between sets of five-word shingles, over all pairs of texts."""
    sets = {i: set(nearcopies.shingle_set(t).tolist()) for i, t in zip(kept[2]["doc_id"], kept[2]["text"])}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
            low, high = sorted((root(a), root(b)))
            up[high] = low
    assert sorted(kept[3]["doc_id"]) == sorted(i for i in sets if root(i) == i)


def test_mix(spark, kept):
    size = {i: len(WORD.findall(t)) for i, t in zip(kept[3]["doc_id"], kept[3]["text"])}
    source = dict(zip(kept[3]["doc_id"], kept[3]["source"]))
    h = {r["doc_id"]: r["h"] for r in spark.createDataFrame(kept[3][["doc_id"]]).select("doc_id", mixing.hash_of(F.col("doc_id")).alias("h")).collect()}
    times = Counter(kept[4]["doc_id"])
    assert set(times.values()) <= {1, 2} and set(times) <= set(size)
    for s in set(source.values()):
        own = sorted((h[i], i) for i in source if source[i] == s)
        taken = [times[i] for _, i in own]
        assert taken == sorted(taken, reverse=True)  # a hash threshold
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * sum(size.values())) <= len(set(source.values())) * max(size.values())


def test_packed(kept):
    last = kept[5]
    assert Counter(last[last["piece"] == 0]["doc_id"]) == Counter(kept[4]["doc_id"])
    places = sorted(zip(last["sequence_id"], last["offset"], last["length"]))
    for (s, o, n), (t, p, _) in zip(places, places[1:]):
        assert p == (o + n if s == t else 0)
    assert max(o + n for _, o, n in places) <= 2048


def test_many_copies_leave_one(spark, sf_dir):
    """Of a text held by ten or more documents one stays through all stages after the classifier; null and blank rows
    pass line dedup as they are."""
    body = "\n".join(f"line {i} of the copied text has some words of its own {i * i}" for i in range(8))
    rows = [(i, body, "en", "a", len(body)) for i in range(12)] + [(20, "another text\nthat is held once only by this row", "en", "a", 47), (21, None, "en", "a", None), (22, " \n", "en", "a", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.drop_lines(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in lines if r["doc_id"] != 21) == sorted((i, t, n) for i, t, *_, n in rows if i != 21)
    assert [(r["text"], r["n_chars"]) for r in lines if r["doc_id"] == 21] == [(None, None)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(lines, docs.schema), sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == {0, 20, 21}
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(kept.collect(), docs.schema), sf_dir)
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(mixed.collect(), docs.schema), sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed.collect()} >= {0}


def _near(rng, similarity, n=400):
    """Two texts of ``n`` words whose five-word shingles have about this Jaccard similarity: single words replaced."""
    words = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
    other, changes = list(words), round((n - 4) * (1 - similarity) / (1 + similarity) / 5)
    for i in range(changes):
        other[5 + i * (n // changes)] = f"x{rng.integers(1 << 40)}"
    return " ".join(words), " ".join(other)


def test_near_copies_from_similarity_080(spark, sf_dir):
    """Pairs at 0.8 to 0.95 keep one row each, as brute force says; pairs below 0.8 keep both. Null and repeated ids too."""
    rng = np.random.default_rng(8)
    texts = [t for k in range(160) for t in _near(rng, 0.805 + 0.145 * k / 159)] + [t for _ in range(40) for t in _near(rng, 0.7)]
    sets = [set(nearcopies.shingle_set(t).tolist()) for t in texts]
    similar = [len(a & b) / len(a | b) >= 0.8 for a, b in zip(sets[::2], sets[1::2])]
    assert sum(similar) >= 150 and not any(similar[160:])
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    kept = {r["text"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()}
    left = [(a in kept) + (b in kept) for a, b in zip(texts[::2], texts[1::2])]
    assert left == [1 if s else 2 for s in similar]


def test_near_copies_in_long_lists(spark):
    """A large group of near copies and its neighbours: with leaders as with all pairs that meet."""
    rng = np.random.default_rng(9)
    words = _near(rng, 0.9, 300)[0].split()
    rows = [(i, " ".join(words[: i % 30 + 2] + [f"v{i}"] + words[i % 30 + 3 :])) for i in range(120)] + [(500 + i, _near(rng, 0.9)[0]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"lead": False}, {"lead": False, "most": 7}, {"most": 7}):
        assert {r["doc_id"] for r in nearcopies.keep_one(docs, **how).collect()} == {0, *range(500, 510)}


def test_near_copies_in_chains(spark):
    """Texts that drift: neighbours are similar, distant ones are not. One group as by brute force, however leaders fall."""
    rng = np.random.default_rng(10)
    words, rows = _near(rng, 0.9, 200)[0].split(), []
    for i in range(60):
        words[(i * 37) % 190 + 2] = f"y{rng.integers(1 << 40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"lead": False, "most": 9}):
        assert [r["doc_id"] for r in nearcopies.keep_one(docs, **how).collect()] == [0]


def test_near_copies_below_the_similarity(spark):
    """A group of which all pairs meet in lists but few are similar: components by brute force, in chunks and as a whole."""
    rng = np.random.default_rng(11)
    words, rows = _near(rng, 0.9, 300)[0].split(), []
    for i in range(150):
        own = list(words)
        for at in rng.choice(290, int(rng.integers(2, 9)), replace=False):
            own[at] = f"z{rng.integers(1 << 40)}"
        rows.append((i, " ".join(own)))
    sets = [set(nearcopies.shingle_set(t).tolist()) for _, t in rows]
    up = list(range(150))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [(a, b) for a, b in itertools.combinations(range(150), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in links:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    want = {i for i in range(150) if root(i) == i}
    assert 5 < len(want) and len(links) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"most": 20}):
        assert {r["doc_id"] for r in nearcopies.keep_one(docs, **how).collect()} == want


def test_near_copies_write_what_meets(spark, monkeypatch):
    """Shingle sets are written for texts that meet others, no others; a list of two, whose pair is verified, is not compared as a whole."""
    rng = np.random.default_rng(12)
    apart = [_near(rng, 0.9)[0] for _ in range(60)]
    pairs = [t for _ in range(20) for t in _near(rng, 0.7)] + [t for _ in range(5) for t in _near(rng, 0.95)]
    rows = list(enumerate([*apart, *pairs, apart[0], apart[0]]))
    written, real = {}, nearcopies.staged

    def staged(df, name, *partitions):
        return written.setdefault(name, real(df, name, *partitions))

    monkeypatch.setattr(nearcopies, "staged", staged)
    kept = {r["doc_id"] for r in nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {*range(100), *range(100, 110, 2)}
    assert [name for name, table in written.items() if "s" in table.columns] == ["sets"]
    assert 40 <= written["sets"].count() == written["asked"].count() <= len(pairs)
    assert written["left"].count() == 0


def test_shared_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 30))).astype(np.int32) for _ in range(20)]
    got = nearcopies.shared_shingles(sets[:8], sets[8:], 7)
    assert got.tolist() == [[len(set(a) & set(b)) for b in sets[8:]] for a in sets[:8]]
