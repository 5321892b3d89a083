"""Similar texts by rare pairs of characters against comparing all with all."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from bidlake.operators import matching

TEXTS = "organization_id string, k string"


def some_texts(seed):
    rnd = random.Random(seed)
    own = ["".join(rnd.choices("abc", k=rnd.randrange(9))) for _ in range(120)] + ["".join(rnd.choices("abcdefgh", k=rnd.randrange(6, 20))) for _ in range(60)]
    others = ["".join(c for c in x if rnd.random() > 0.1) + rnd.choice(["", "a", "zz"]) for x in own]
    return sorted({*own}), sorted({*own[::2], *others})


@pytest.mark.parametrize("least", [0.68, 0.775, 0.78, 0.9, 1.0])
def test_no_close_pair_is_missed(spark, least):
    left, right = some_texts(int(least * 1000))
    rows = (spark.createDataFrame([("o", t) for t in ts], TEXTS) for ts in (left, right))
    got = {(r["ka"], r["kb"]) for r in matching.close_pairs(*rows, least).collect()}
    want = {(a, b) for a in left for b in right if difflib.SequenceMatcher(None, a, b).ratio() >= least}
    assert want <= got and want
    assert len(got) < len(left) * len(right) * (0.6 if least < 0.7 else 0.4)


def test_ratio_of_two_thirds_has_no_signature(spark):
    texts = spark.createDataFrame([("o", "abc")], TEXTS)
    with pytest.raises(ValueError):
        matching.close_pairs(texts, texts, 2 / 3)


def test_suppliers(spark):
    """Up to three suppliers by their best name, by score and id; tenants apart; empty and null texts."""
    left, right = some_texts(5)
    asked = [("o", i, t) for i, t in enumerate(left)] + [("other", -1, left[40]), ("o", -2, None)]
    known = [("o", i, t, [right[-i - 1], None] if i % 2 else None) for i, t in enumerate(right)]
    got = {}
    found = matching.possible_suppliers(spark.createDataFrame(asked, "organization_id string, left_id long, text string"), spark.createDataFrame(known, "organization_id string, supplier_id long, name string, aliases array<string>"))
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["left_id"], []).append((r["right_id"], r["score"]))
    want = {}
    for org, i, text in asked:
        if org == "o":
            ratio = lambda n: difflib.SequenceMatcher(None, text or "", n or "").ratio()
            scored = sorted((-max(ratio(n) for n in [name, *(aliases or [])]), k) for _, k, name, aliases in known)
            best = [(k, -s) for s, k in scored[:3] if -s >= 0.78]
            if best:
                want[i] = best
    assert got == want


def test_one_shared_run_of_characters(spark):
    """100,000 texts that share three characters: the pair of characters that all share is no text's rarest, so no group holds them all."""
    k = F.concat(F.lit("zzz"), F.translate(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 14), "0123456789", "ghijklmnop"))
    texts = spark.range(100_000).select(F.lit("o").alias("organization_id"), k.alias("k"))
    own = matching.signatures(texts, matching.rarity(texts), 0.78)
    largest = own.groupBy("gram").count().agg(F.max("count")).first()[0]
    assert largest < 10_000 and own.where("gram like 'zz#%'").count() == 0


def test_unlike_texts_are_no_pairs(spark):
    """Texts of a small alphabet share pairs of characters without being alike: none is missed, and few of the two million pairs are left."""
    spelled = F.sha2(F.col("id").cast("string"), 256).substr(1, 12)
    known = spark.range(2000).select(F.lit("o").alias("organization_id"), spelled.alias("k"))
    asked = known.limit(1000).withColumn("k", F.concat(F.lit("x"), F.col("k")))
    left, right = ([r["k"] for r in t.collect()] for t in (asked, known))
    got = {(r["ka"], r["kb"]) for r in matching.close_pairs(asked, known, 0.78).collect()}
    assert {(k, k[1:]) for k in left} <= got and len(got) < 2 * len(left)
    assert set(right) >= {b for _, b in got}
