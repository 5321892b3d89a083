"""Secret scans with corpus-wide ownership frequency.

Spans are found in every whole text by fixed patterns and, beside those, as long mixed tokens that look like keys.
Each candidate's hash is counted over the corpus by distinct repositories and owners. A value that several owners hold,
or that one owner has copied over many repositories, is a widely copied example; one that stays with few is
live-looking. Every span gets that verdict. Base spans always stay; mixed tokens that are examples are dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.llm.common import fresh, numbered, once, small_batches

#: Fixed patterns, in the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "mixed")
STEMS = ("passw", "secret", "token", "api")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
MIN_ENTROPY = 3.5


def _has_long_word(text: str, n: int) -> bool:
    return max(map(len, text.split()), default=0) >= n


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, kind number, end, value)`` of the base spans, by start and then kind."""
    out, low = [], text.lower()
    if any(x in low for x in STEMS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if _has_long_word(text, 20):
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def mixed_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens with lower case, upper case and digits, of high entropy, that touch no base span."""
    out = []
    for m in MIXED.finditer(text) if _has_long_word(text, 24) else ():
        v = m[0]
        if not (re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v)):
            continue
        n = len(v)
        if -sum(c / n * math.log2(c / n) for c in Counter(v).values()) < MIN_ENTROPY:
            continue
        if all(m.end() <= b[0] or b[2] <= m.start() for b in base):
            out.append((m.start(), 3, m.end(), v))
    return out


#: A run of characters as long as all spans but assignments have at least.
LONG_RUN = "[A-Za-z0-9+/_=-]{20}"


def _may_hold(text: Column) -> Column:
    """Whether a text can hold a candidate; a cheap test in the JVM, so that all other rows pass through untouched."""
    low = F.lower(text)
    stems = [F.contains(low, F.lit(s)) for s in STEMS]
    return F.coalesce(stems[0] | stems[1] | stems[2] | stems[3] | text.rlike(LONG_RUN), F.lit(False))


_SPANS = "array<struct<start:long,kind:int,end:long,h:string>>"


def _candidates(text: Column) -> Column:
    @F.pandas_udf(_SPANS)
    def find(text: pd.Series) -> pd.Series:
        rows = []
        for t in text:
            base = base_spans(t)
            found = sorted(base + mixed_spans(t, base))
            rows.append([{"start": s, "kind": n, "end": e, "h": hashlib.sha256(v.encode()).hexdigest()} for s, n, e, v in found])
        return pd.Series(rows, dtype=object)

    return once(find)(text)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _n_of(spans: Column, kind: int) -> Column:
    """How many spans are of a kind. The filter's function has one argument: Spark gives a second one the position."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = 3, example_repos: int = 20) -> DataFrame:
    """Add ``n_assign, n_access, n_hex, n_live, n_example, base_sha256, spans, verdicts`` to ``docs(text, ...)``.

    ``repository`` and ``owner`` name the columns that say where a text is from; null is one repository and one owner.
    A value is an example if ``example_owners`` or more owners hold it or ``example_repos`` or more repositories do, else
    live-looking; ``verdicts`` says which for each of ``spans``, in order. Null text is empty and has no spans (their list is
    the empty text); rows of one text get the same spans; an empty table stays empty. Columns with such names stay; the new
    ones then get underscores in front.

    Rows that cannot hold a candidate are neither written nor shuffled; the others are written once with their candidates
    and a row number, and only numbers, positions and hashes are joined.
    """
    small_batches(docs.sparkSession)
    names = [*(f"n_{k}" for k in KINDS[:3]), "n_live", "n_example", "base_sha256", "spans", "verdicts"]
    *new, found, row = fresh(docs, *names, "found", "row_number")
    may = _may_hold(F.col("text"))
    some = numbered(docs.where(may).withColumn(found, _candidates(F.col("text"))), row)
    where = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((repository, "repo"), (owner, "owner"))]
    hits = some.select(F.col(row).alias("k"), *where, F.explode(found).alias("s"))
    one = hits.select("repo", "owner", "s.h").distinct()
    spread = one.groupBy("h", "owner").agg(F.count("*").alias("r")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("r").alias("repos"))
    example = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    marked = hits.join(spread.select(F.col("h"), example.alias("example")), F.col("s.h") == F.col("h"))
    marked = marked.where((F.col("s.kind") < 3) | ~F.col("example")).select("k", F.struct("s.start", "s.kind", "s.end", "example").alias("s"))
    per = marked.groupBy("k").agg(F.array_sort(F.collect_list("s")).alias(found))
    kind = per.schema[found].dataType
    judged = some.drop(found).join(per.withColumnRenamed("k", row), row, "left").drop(row)
    out = judged.unionByName(docs.where(~may).withColumn(found, F.lit(None).cast(kind)))
    spans = F.coalesce(F.col(found), F.array().cast(kind))
    base = F.filter(spans, lambda s: s["kind"] < 3)
    values = [_n_of(spans, kind).cast("long") for kind in range(3)]
    values += [F.size(F.filter(spans, lambda s: ~s["example"])).cast("long"), F.size(F.filter(spans, lambda s: s["example"])).cast("long")]
    verdicts = F.array_join(F.transform(spans, lambda s: F.when(s["example"], "example").otherwise("live")), ",")
    values += [F.sha2(_joined(base).cast("binary"), 256), _joined(spans), verdicts]
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), *(v.alias(n) for v, n in zip(values, new, strict=True)))
