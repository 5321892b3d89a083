"""URL filters: allow and block rules by host and path, and an exact host list as a cascade of Bloom filters.

The cascade encodes which keys of a complete universe are listed. Level 0 holds the listed keys; the other keys of
the universe that it lets through form level 1; the listed keys that level 1 lets through form level 2; and so on,
until a level lets nothing wrong through. A key is listed if the first level that rejects it has an odd number, or if
it passes all of an odd number of levels. For every key of the universe that is exact, without a join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import fresh, staged

#: Listed keys up to which the cascade is built and broadcast: its first level then has some 80 MB, and levels shrink.
MAX_LISTED = 100_000_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; none: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; none: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule (host and path as one string) and its verdict for the longest of ``rules(verdict, host, path)`` that
    fits: its host or a subdomain of it, and a path that starts with its path. Null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


class Cascade:
    """Levels ``(seed, bits, hashes, words)`` of Bloom filters over keys given by two 64-bit hashes."""

    def __init__(self, levels: list[tuple[int, int, int, np.ndarray]]):
        self.levels = levels

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, left = np.full(len(h1), len(self.levels) % 2 == 1), np.arange(len(h1))
        for n, (seed, bits, hashes, words) in enumerate(self.levels):
            inside = np.ones(len(left), dtype=bool)
            for i in range(hashes):
                at = _position(h1[left], h2[left], seed, i, bits)
                inside &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            out[left[~inside]] = n % 2 == 1
            left = left[inside]
        return out


def _position(h1: np.ndarray, h2: np.ndarray, seed: int, i: int, bits: int) -> np.ndarray:
    """The i-th bit of a key at a level. Mixed again by level, since levels must err independently."""
    x = h1.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) % (1 << 64)) * (h2.view(np.uint64) | np.uint64(1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(bits)


def _judged(cascade: Cascade):
    @F.pandas_udf("boolean")
    def judged(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(cascade.listed(h1.to_numpy(), h2.to_numpy()))

    return judged


def _positions(seed: int, bits: int, hashes: int):
    @F.pandas_udf("array<long>")
    def positions(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy(), h2.to_numpy()
        at = [_position(a, b, seed, i, bits).astype(np.int64) for i in range(hashes)]
        return pd.Series(list(np.stack(at, axis=1)), dtype=object)

    return positions


def build_cascade(universe: DataFrame, first_rate: float = 0.05, rate: float = 0.5) -> Cascade:
    """The cascade for ``universe(key string, listed boolean)``, keys distinct.

    Each level's bits are set on the executors and or-ed as 64-bit words by partial aggregation; only words that have
    bits come to the driver, at most ``MAX_BITS / 64`` of them, a size that the number of the level's keys fixes
    beforehand. The keys themselves stay where they are.
    """
    keys = staged(universe.select(F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"), "listed"), "keys")
    levels: list[tuple[int, int, int, np.ndarray]] = []
    while True:
        n, held, rest = len(levels), len(levels) % 2 == 0, Cascade(levels)
        if levels:
            # keys that the levels so far judge wrong are the ones this level must hold
            wrong = keys.where(F.col("listed") == F.lit(held)).where(_judged(rest)("h1", "h2") != F.lit(held))
        else:
            wrong = keys.where("listed")
        wrong = staged(wrong.select("h1", "h2"), "level")
        count = wrong.count()
        if not count:
            return Cascade(levels)
        p = first_rate if not levels else rate
        bits = max(64, math.ceil(-count * math.log(p) / math.log(2) ** 2))
        hashes = max(1, round(-math.log2(p)))

        at = wrong.select(F.explode(_positions(n, bits, hashes)("h1", "h2")).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        got = words.toPandas()
        table = np.zeros(-(-bits // 64), dtype=np.uint64)
        table[got["word"].to_numpy()] = got["bits"].to_numpy(dtype=np.int64).view(np.uint64)
        levels.append((n, bits, hashes, table))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, max_listed: int = MAX_LISTED) -> DataFrame:
    """Add ``host, path, rule, verdict`` to ``pages(url, ...)``. A url that no rule fits is blocked if its host is one of
    ``listed(key)``, else allowed, as the cascade over all hosts of the pages says.

    Null urls and urls without ``://`` have an empty host and path and are judged like any other; null and repeated keys of
    the list count once or not at all. Repeated rows are judged alike; an empty table stays empty. Columns with such names
    stay; the new ones then get underscores. Beyond ``max_listed`` listed hosts, of which nothing is broadcast then, hosts are
    looked up by a join, with the same result.
    """
    host, path, rule, verdict, name, own, by_rule = fresh(pages, "host", "path", "rule", "verdict", "key", "fit", "listed")
    keys = listed.select("key").where("key is not null").distinct()
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct().join(keys.withColumn("listed", F.lit(True)), "key", "left")
    hosts = staged(hosts.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "hosts")
    fit, said = rule_of(F.col(host), F.col(path), rules)
    parts = pages.withColumn(host, host_of(F.col("url"))).withColumn(path, path_of(F.col("url"))).withColumn(rule, fit).withColumn(own, said)
    if hosts.where("listed").count() > max_listed:
        found = hosts.where("listed").select(F.col("key").alias(name), F.lit(True).alias(by_rule))
        parts = parts.join(found, F.col(host) == F.col(name), "left").withColumn(name, F.coalesce(by_rule, F.lit(False)))
    else:
        cascade = build_cascade(hosts)
        parts = parts.withColumn(name, _judged(cascade)(F.xxhash64(host), F.xxhash64(host, F.lit(1))))
    by_list = F.when(F.col(name), "block").otherwise("allow")
    return parts.select(*(F.col(f"`{c}`") for c in pages.columns), host, path, rule, F.coalesce(own, by_list).alias(verdict))
