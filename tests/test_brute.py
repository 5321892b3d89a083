"""Queries without SQL against plain Python over the whole small tables."""

import collections
import difflib
import os
import re

import pandas as pd

from bidlake import plans


def table(sf_dir, name):
    return pd.read_parquet(f"{sf_dir}/{name}.parquet")


def test_first_event_limit(spark, sf_dir):
    """Of each type's events those beyond three in the half hour from the first one of a span."""
    sf_dir = os.path.join(os.path.dirname(sf_dir), "sf0.01")  # the smallest events never come so close
    want = collections.Counter()
    for kind, own in table(sf_dir, "events").sort_values("ts").groupby("event_type"):
        start, n = None, 0
        for t in own["ts"]:
            if start is None or (t - start).total_seconds() > 1800:
                start, n = t, 0
            n += 1
            want[kind] += n > 3
    got = {r["key"]: r["n"] for r in plans.queries()["stream_first_event_limit"](spark, sf_dir).collect()}
    assert got == {k: n for k, n in want.items() if n} and got


def test_item_suggestions(spark, sf_dir):
    """Of each part the three most similar descriptions among those that share three characters, by ratio and id."""
    parts = table(sf_dir, "part")
    key = lambda x: re.sub("[^a-z0-9]", "", x.lower())
    asked = {k: key(f"{t} {n[::-1]}") for k, t, n in zip(parts["p_partkey"], parts["p_type"], parts["p_name"])}
    items = {k: key(f"{n} {t}") for k, t, n in zip(parts["p_partkey"], parts["p_type"], parts["p_name"])}
    grams = lambda x: {x[i : i + 3] for i in range(max(1, len(x) - 2))}
    texts = collections.defaultdict(list)
    for i, t in sorted(items.items()):
        texts[t].append(i)
    of = {t: grams(t) for t in texts}
    best = {}
    for q in set(asked.values()):
        own = grams(q)
        scored = [(-round(difflib.SequenceMatcher(None, q, t).ratio(), 2), i) for t, ids in texts.items() if own & of[t] for i in ids[:3]]
        best[q] = [(i, -s) for s, i in sorted(scored)[:3]]
    got = collections.defaultdict(list)
    for r in sorted(plans.queries()["item_suggestions"](spark, sf_dir).collect(), key=lambda r: r["rank"]):
        got[r["part"]].append((r["item_id"], r["score"]))
    assert got == {p: best[q] for p, q in asked.items() if best[q]}


def test_source_alignment(spark, sf_dir):
    """Every row takes the first line left of its part number, else the first one left; rows without stay if viable."""
    lines, orders = table(sf_dir, "lineitem"), table(sf_dir, "orders")
    kept = lines[lines["l_orderkey"].isin(orders["o_orderkey"]) & lines["l_partkey"].isin(table(sf_dir, "part")["p_partkey"]) & lines["l_suppkey"].isin(table(sf_dir, "supplier")["s_suppkey"])]
    kept = kept.assign(cents=lambda d: (d["l_extendedprice"] * 100).round().astype("int64"), q=lambda d: d["l_quantity"].astype("int64"))
    kept = kept.assign(price=lambda d: (d["cents"] * 20000 + d["q"]) // (d["q"] * 2), id=lambda d: d[["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]].astype(str).agg("-".join, axis=1))
    want = set()
    for doc, own in kept.sort_values(["l_orderkey", "l_linenumber", "id", "q", "price"]).groupby("l_orderkey"):
        rows = [(n, str(p), s % 2 == 0) for n, (p, s) in enumerate(zip(own["l_partkey"], own["l_suppkey"]))]
        left = sorted((100 - n, p if int(p) % 5 else None) for n, p, _ in rows if int(p) % 6)
        at = 0
        for n, sku, viable in rows:
            hit = next((x for x in left if x[1] == sku), left[0] if left else None)
            if hit:
                left.remove(hit)
            if hit or viable:
                want.add((doc, at, n, hit[0] if hit else None))
                at += 1
        want |= {(doc, at + i, None, no) for i, (no, _) in enumerate(left)}
    got = [tuple(r) for r in plans.queries()["source_alignment"](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want
