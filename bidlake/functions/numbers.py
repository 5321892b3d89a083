"""Numbers, dates and money as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """Two decimals, half up."""
    return F.round(x, 2).cast("decimal(18,2)")


def pct_change(current: Column, base: Column) -> Column:
    """Null when the base is null or zero."""
    return F.try_divide(current - base, base)


def ratio(n: Column, d: Column) -> Column:
    """``struct(numerator, denominator, percent)``; the percentage has 3 decimals and is null without a denominator."""
    return F.struct(n.alias("numerator"), d.alias("denominator"), percent(n, d).alias("percent"))


def percent(n: Column, d: Column) -> Column:
    """100 n / d with 3 decimals, half up on exact integers; null without a denominator."""
    n, d = n.cast("decimal(20,0)"), d.cast("decimal(20,0)")
    return F.when(d != 0, F.floor((n * 200_000 + d) / (d * 2)).cast("double") / 1000)


def parse_number(s: Column, mode: str = "locale") -> Column:
    """A number's text as decimal(28,6), null if it is none.

    ``locale``: the last of comma and point is the decimal mark; a lone comma before exactly three digits groups, any
    other is the decimal mark. ``plain``: all but digits, points and a leading minus is dropped.
    """
    if mode == "plain":
        return F.regexp_replace(s, r"(?<!^)-|[^0-9.-]", "").try_cast("decimal(28,6)")
    t = F.regexp_replace(F.trim(s), r"[\s']", "")
    comma, point = F.length(F.regexp_extract(t, "^(.*),", 1)), F.length(F.regexp_extract(t, r"^(.*)\.", 1))
    both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    english, continental = F.replace(t, F.lit(","), F.lit("")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.when(both & (comma > point), continental).when(both, english).when(t.rlike(r"^-?\d{1,3}(,\d{3})+$"), english).when(F.contains(t, F.lit(",")), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    return F.when(plain.rlike(r"^-?(\d+(\.\d*)?|\.\d+)$"), plain.try_cast("decimal(28,6)"))


def field_number(s: Column) -> Column:
    """``parse_number`` of a cell that may carry a currency; ranges and percentages are null."""
    bare = F.regexp_replace(F.trim(s), r"(?i)^(USD|EUR|GBP|CAD|AUD|JPY|CHF|US\$|[$€£¥])\s*|\s*(USD|EUR|GBP|CAD|AUD|JPY|CHF|[$€£¥])$", "")
    bare = F.regexp_replace(bare, r"(?<=\d)\s*([.,])\s*(?=\d)", "$1")
    # most are bare digits, which need none of this
    return F.when(s.rlike(r"^\d+(\.\d+)?\z"), s.try_cast("decimal(28,6)")).when(~F.coalesce(s.rlike(r"%|\d\s*[-–]\s*\d"), F.lit(True)), parse_number(bare))


def lead_days(s: Column, mode: str = "schema") -> Column:
    """A lead time's text in days, null if it is none.

    ``schema``: needs a word for days or weeks, the largest number counts. ``email``: any integers, the largest counts,
    wk is a week. ``evidence``: the whole text must be a number or range with a unit.
    """
    numbers = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))
    most = F.array_max(numbers)
    days = most * F.when(F.lower(s).rlike("week|wk"), 7).otherwise(1)
    if mode == "email":
        return days
    fits = r"^\s*\d+\s*((-|–|to)\s*\d+\s*)?(business |working |calendar )?(days?|weeks?|wks?)\s*$" if mode == "evidence" else "day|week"
    return F.when(F.lower(s).rlike(fits), days)


def parse_date(s: Column, day_first: Column | None = None) -> Column:
    """ISO dates, month names in either order, and numeric dates that only read one way (or as ``day_first`` says)."""
    t = F.trim(s)
    named = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")]
    a, b, y = (F.regexp_extract(t, r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})$", i).try_cast("int") for i in (1, 2, 3))
    day = F.when((a > 12) & (b <= 12), True).when((b > 12) & (a <= 12), False).when(a == b, True)
    day = F.coalesce(day, day_first) if day_first is not None else day
    text = F.when(day, F.format_string("%04d-%02d-%02d", y, b, a)).when(~day, F.format_string("%04d-%02d-%02d", y, a, b))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    return F.coalesce(F.to_date(F.coalesce(iso, text).try_cast("date")), *named)


def power_of_ten_off(a: Column, b: Column) -> Column:
    """Whether two amounts differ by a factor of 10 or 100: a misplaced decimal mark."""
    a, b = a.cast("decimal(18,6)"), b.cast("decimal(18,6)")
    return F.coalesce((a != 0) & ((a * 10 == b) | (a * 100 == b) | (b * 10 == a) | (b * 100 == a)), F.lit(False))


def off_by(a: Column, b: Column, tolerance: str = "0.02") -> Column:
    """Whether two known amounts differ by more than the tolerance."""
    return F.coalesce(F.abs(a - b) > F.lit(tolerance).cast("decimal(18,2)"), F.lit(False))


def fits_scale(raw: Column, places: int) -> Column:
    """Whether a number's text is finite with at most so many decimals."""
    return F.coalesce(raw.rlike(rf"^-?\d+(\.\d{{0,{places}}}0*)?$"), F.lit(False))


def same_value(field: Column, a: Column, b: Column, numeric: tuple[str, ...]) -> Column:
    """Equality of two texts as values of a field: numbers by value, others trimmed and case folded; null only equals null."""
    text = lambda x: F.replace(F.lower(F.trim(x)), F.lit("ß"), F.lit("ss"))
    number = lambda x: x.try_cast("decimal(28,6)")
    both = number(a).isNotNull() & number(b).isNotNull()
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(field.isin(*numeric) & both, number(a) == number(b)).otherwise(text(a) == text(b))
