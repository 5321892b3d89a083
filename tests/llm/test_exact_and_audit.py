"""Exact dedup and the filter audit: SQL over whole tables, brute force, and edges."""

import hashlib
import itertools
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm import exactdedup, filteraudit
from bidlake.llm import queries as q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_filter_audit"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(q.SQL[name]).df()
    got = q.QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    plain = lambda d: sorted(map(tuple, d.astype(object).values.tolist()))
    assert plain(got) == plain(want) and len(got)


def polynomial(raw, base):
    h = 0
    for x in raw:
        h = (h * base + x) % exactdedup.PRIME
    return h


def test_fingerprints_compose():
    rng = np.random.default_rng(1)
    strings = [b"", b"\x00", b"a", bytes(64), *(rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (63, 64, 65, 1000, 5000))]
    offsets = np.cumsum([0, *map(len, strings)])
    own = exactdedup.Polynomial().hashes(np.frombuffer(b"".join(strings), np.uint8), offsets)
    assert own.tolist() == [[polynomial(s, b) for b in exactdedup.BASES] for s in strings]
    assert exactdedup.combine(own.tolist(), [len(s) for s in strings]) == [polynomial(b"".join(strings), b) for b in exactdedup.BASES]


@pytest.mark.parametrize("chunk", [64, 7, 65_536])
def test_chunks_give_the_fingerprint_of_the_whole(spark, chunk):
    texts = ["", None, "x", "é" * 50, "word " * 500, "word " * 500, "b" * 64, "b" * 65]
    rows = spark.createDataFrame([(i, None if t is None else t.encode()) for i, t in enumerate(texts)], "row long, raw binary")
    got = {r["row"]: (r["size"], r["fingerprint"]) for r in exactdedup.fingerprints(rows, "raw", chunk=chunk).collect()}
    assert got == {i: (None, None) if t is None else (len(t.encode()), [polynomial(t.encode(), b) for b in exactdedup.BASES]) for i, t in enumerate(texts)}


ROWS = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (None, "a"), (None, None), (None, ""), (4, "c" * 200_000), (5, "c" * 200_000), (6, "c" * 199_999 + "d"), (7, "ab"), (8, "ba"), (9, "é"), (10, "é")]


@pytest.mark.parametrize("bases", [exactdedup.BASES, (1,)])
def test_exact_edges(spark, bases):
    """A base of one makes a sum of bytes of the fingerprint, which collides: comparison tells the texts apart all the same."""
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in ROWS], DOCS).withColumns({"row": F.lit("own"), "key": F.lit("own"), "kept": F.lit("own"), "raw": F.lit("own")})
    got = [tuple(r) for r in exactdedup.exact_duplicates(docs, bases=bases, chunk=1000).collect()]
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        want.update((i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((a, b, c, e) for a, b, c, _, e in got) == want
    kept = Counter(e for *_, k, e in got if k)
    assert set(kept.values()) == {1} and len(kept) == len(groups) and all(a == b for a, b, _, k, _ in got if k)


def test_exact_normalised_and_empty(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exactdedup.exact_duplicates(docs, F.lower).collect()} == {(1, 2), (2, 2)}
    assert exactdedup.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_copies_are_spread(spark):
    """A third of the rows are copies: members meet copies of the chunks of the row that stays, and no row is lost."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same " * 20)).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exactdedup.exact_duplicates(docs).groupBy("group_size").agg(F.count("*").alias("n"), F.max("keep_id").alias("keep"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()
    assert {tuple(r) for r in got} == {(3000, 3000, 8997, 1), (1, 6000, 8999, 6000)}


def brute_audit(rows, letters):
    """``rows``: part, failures, good, toxic."""
    out = {}
    for part in {r[0] for r in rows}:
        own, taken = [r for r in rows if r[0] == part], Counter()
        for order in itertools.permutations(range(len(letters))):
            left = list(own)
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                failing = sum(r[1][f] for r in own)
                alone = sum(r[1][f] and sum(r[1]) == 1 for r in own)
                taken[f] += len(gone)
                out[part, "".join(letters[x] for x in order), k + 1] = [len(left), len(gone), failing - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = taken[v[6]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("letters", ["A", "ABC", "ABCDE"])
def test_audit_against_brute_force(spark, letters):
    rng = np.random.default_rng(len(letters))
    rows = [(f"p{rng.integers(3)}", tuple(bool(x) for x in rng.integers(0, 2, len(letters))), int(rng.integers(2)), int(rng.integers(2))) for _ in range(300)]
    flags = ", ".join(f"f{i} boolean" for i in range(len(letters)))
    df = spark.createDataFrame([(p, *fs, bool(g), bool(t), "x") for p, fs, g, t in rows], f"part string, {flags}, good boolean, toxic boolean, mask string")
    got = filteraudit.audit(df, [(x, f"f{i}") for i, x in enumerate(letters)]).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute_audit(rows, letters) and len(got) == len(brute_audit(rows, letters))


def test_gray_walk_states():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 50, (4, 32, 3))
    states = filteraudit.walk(cells)
    for s in range(32):
        assert (states[:, s] == cells[:, [m for m in range(32) if not m & s]].sum(axis=1)).all()


def test_audit_edges(spark):
    """Null ids, texts, sources and labels; repeated rows and ids; long texts; clashing names; no rows."""
    rows = [(1, "x", "en", None, 1), (1, "x", "en", None, 1), (2, "x", "en", "", 1), (None, "x", "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "W " * 100_000, "en", "s", 0), (6, " ".join("abc"), "en", "s", 5)]
    labels = spark.createDataFrame([(2, 1, None), (2, 0, 1), (None, 1, 1), (3, None, None)], LABELS)
    docs = spark.createDataFrame(rows, DOCS).withColumns({"part": F.lit("own"), "digest": F.lit("own"), "good": F.lit("own")})
    failed = {(r["doc_id"], r["part"]): r for r in filteraudit.text_failures(docs, labels).collect()}
    assert not failed[1, None]["repeated"] and failed[2, ""]["repeated"] and not failed[None, "s"]["repeated"] and failed[4, "s"]["repeated"] and not failed[3, "s"]["repeated"]
    assert failed[2, ""]["good"] and failed[2, ""]["toxic"] and not failed[None, "s"]["good"] and not failed[3, "s"]["good"]
    long = failed[5, "s"]
    assert (long["few_words"], long["few_distinct"], long["capitals"], long["marks"]) == (False, True, True, False)
    assert not failed[3, "s"]["few_distinct"] and not failed[3, "s"]["capitals"] and failed[6, "s"]["few_words"]
    audited = filteraudit.audit(filteraudit.text_failures(docs, labels), q.AUDITED).collect()
    assert {r["part"] for r in audited} == {"", "s"} and len(audited) == 1200
    assert {r["kept"] + r["removed"] for r in audited if r["step"] == 1 and r["part"] == ""} == {3}
    none = filteraudit.text_failures(spark.createDataFrame([], DOCS), labels)
    assert filteraudit.audit(none, q.AUDITED).count() == 0
