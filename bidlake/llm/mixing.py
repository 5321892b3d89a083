"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. A budget of a source is met by the documents whose hash lies at or
below a threshold, so a larger budget always takes a superset of a smaller one and nothing has to be sorted. The
thresholds come from histograms: sizes are summed by source and hash bucket, the running sum over the (at most 4096)
buckets of a source shows in which one the budget ends, and only that bucket is split again, five times, down to
single hashes. Partial aggregation keeps a hot source from being one task's work: a source is 4096 rows after it, of which
running sums see 64 at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import fresh, n_words, staged

#: Bits of the document hash, and bits that one histogram resolves.
HASH_BITS, STEP_BITS = 60, 12


def hash_of(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id as text; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most_times: int) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: sources in order of code point, null last, get ``weights`` in turn
    and share ``percent`` of all sizes; a target stops at ``most_times`` its source's size and the excess is shared
    again by weight. Integers up to one final division, so the result is the same on every run.

    The rule that shares again until none is above ends where sources, by size per weight, are full up to some rank:
    source j is full if ``most * size_j / w_j`` is at most what is left per weight. One row per source is sorted here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long")
    whole = "decimal(20,0)"
    named = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * most_times).cast(whole))
    by_room = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = (
        named.withColumn("budget", F.sum("source_size").over(every).cast(whole) * percent)
        .withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(whole) * 100)
        .withColumn("weight_left", F.sum("w").over(rest))
        .withColumn("full", F.col("cap") * F.col("weight_left") * 100 <= F.col("w") * (F.col("budget") - F.col("used")))
    )
    first_open = F.min(F.when(~F.col("full"), F.struct(F.col("used"), -F.col("weight_left")))).over(every)
    return filled.withColumn("open", first_open).select(
        "source",
        "source_size",
        F.when(F.col("full") | F.col("open").isNull(), F.col("cap").cast("double"))
        .otherwise((F.col("w") * (F.col("budget") - F.col("open.used"))).cast("double") / (F.lit(-100) * F.col("open.col2")).cast("double"))
        .alias("target"),
    )


def _crossed(sums: DataFrame, unit: str) -> DataFrame:
    """Of ``sums(source, budget, below, <unit>, n)`` the first unit of each budget whose running sum, on top of ``below``, exceeds it:
    ``source, budget, <unit>, below``, with what lies below that unit. Budgets that are never exceeded have no row."""
    w = Window.partitionBy("source", "budget").orderBy(unit)
    run = sums.withColumn("upto", F.col("below") + F.sum("n").over(w)).where("upto > budget")
    first = run.groupBy("source", "budget").agg(F.min(F.struct(unit, (F.col("upto") - F.col("n")).alias("below"))).alias("x"))
    return first.select("source", "budget", f"x.{unit}", "x.below")


def thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """For ``docs(source, h, size)`` and ``budgets(source, budget)`` (several a source: nested), the largest hash up
    to which a source's sizes sum to at most the budget: rows ``(source, budget, threshold)``, -1 if none fits.

    The buckets of a histogram are summed in 64 groups first, so that a running sum is over 64 rows, never over 4096."""
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    half = STEP_BITS // 2
    for step in range(HASH_BITS // STEP_BITS):
        shift = HASH_BITS - STEP_BITS * (step + 1)
        d, b = docs.select("source", "size", F.shiftright("h", shift).alias("bucket")).alias("d"), state.alias("b")
        inside = F.col("d.source").eqNullSafe(F.col("b.source"))
        if step:
            inside &= F.shiftright("d.bucket", STEP_BITS) == F.col("b.prefix")
        hist = d.join(b, inside).groupBy("b.source", "b.budget", "b.below", "d.bucket").agg(F.sum("d.size").alias("n"))
        hist = staged(hist, "histogram").withColumn("part", F.shiftright("bucket", half))
        part = _crossed(hist.groupBy("source", "budget", "below", "part").agg(F.sum("n").alias("n")), "part").alias("p")
        # the first bucket that ends above the budget is split next; a source that ends within its budget keeps everything
        within = hist.alias("h").join(part, F.col("h.source").eqNullSafe(F.col("p.source")) & (F.col("h.budget") == F.col("p.budget")) & (F.col("h.part") == F.col("p.part")))
        over = _crossed(within.select("h.source", "h.budget", "p.below", "h.bucket", "h.n"), "bucket")
        s, o = state.select("source", "budget").alias("s"), over.alias("o")
        state = (
            s.join(o, F.col("s.source").eqNullSafe(F.col("o.source")) & (F.col("s.budget") == F.col("o.budget")), "left")
            .select("s.source", "s.budget", F.col("o.below"), F.coalesce(F.col("o.bucket"), F.lit(1).cast("long") * (1 << (HASH_BITS - shift)) - 1).alias("prefix"), F.col("o.bucket").isNull().alias("all"))
        )
        state = staged(state.withColumn("below", F.coalesce("below", F.lit(0).cast("long"))), "state")
    return state.select("source", "budget", F.when(F.col("all"), F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most_times: int = 2, size: str | None = None) -> DataFrame:
    """Add ``size, source_size, target, times`` to ``docs(doc_id, text, source, ...)``: how often the mix takes a row.

    A source whose target is t times its size takes all its documents floor(t) times and those under a hash threshold
    once more. ``size`` names a column that has the sizes already (not null); else the words of ``text`` are counted.
    Null sources form a source, null text has size 0 (and is taken as its hash says), rows that share an id are taken
    alike, an empty table stays empty. Columns of ``docs`` with such names stay; the new ones then get underscores
    in front.
    """
    h, n, source_size, target, times = fresh(docs, "h", "size", "source_size", "target", "times")
    counted = docs.withColumn(h, hash_of(F.col("doc_id"))).withColumn(n, F.col(size) if size else n_words(F.col("text")))
    base = staged(counted.select("source", F.col(h).alias("h"), F.col(n).alias("size")), "sizes")
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most_times)
    whole = F.floor(F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0)))
    goal = staged(goal.withColumn("whole", whole.cast("long")), "targets")
    part = goal.select("source", (F.floor("target") - F.col("whole") * F.col("source_size")).cast("long").alias("budget"))
    cut = thresholds(base, part.where("budget > 0"))
    g, c = goal.alias("g"), cut.alias("c")
    per = g.join(c, F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.*", F.coalesce("c.threshold", F.lit(-1)).alias("threshold"))
    per = staged(per, "plan").alias("p")
    taken = F.col("p.whole") + (F.col(f"d.{h}") <= F.col("p.threshold")).cast("long")
    return counted.alias("d").join(per, F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        *(F.col(f"d.`{x}`") for x in docs.columns),
        F.col(f"d.{n}"),
        F.col("p.source_size").alias(source_size),
        F.col("p.target").alias(target),
        F.least(taken, F.lit(most_times)).alias(times),
    )


def repeated(mixed: DataFrame, times: str = "times") -> DataFrame:
    """The rows of ``mixed`` as often as ``times`` says, without that column."""
    return mixed.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).drop(times)
