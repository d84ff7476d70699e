"""Dates, shares, weights and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of report windows; an unknown label means a week, "all" no bound.
SPANS = {"24h": "24 HOURS", "7d": "7 DAYS", "30d": "30 DAYS", "90d": "90 DAYS"}


def span(label: str) -> str | None:
    return None if label == "all" else SPANS.get(label, SPANS["7d"])


def since(as_of: Column, label: str) -> Column:
    """Where the window of this label begins; a null timestamp for "all"."""
    length = span(label)
    return F.lit(None).cast("timestamp_ntz") if length is None else as_of - F.expr(f"INTERVAL {length}")


def previous_since(as_of: Column, label: str) -> Column:
    """Where the window of the same length before it begins."""
    length = span(label)
    return F.lit(None).cast("timestamp_ntz") if length is None else as_of - F.expr(f"INTERVAL {length}") - F.expr(f"INTERVAL {length}")


def bucket(ts: Column, unit: str) -> Column:
    """D3: the label of a day or hour."""
    return F.date_format(ts, "yyyy-MM-dd HH:00" if unit == "hour" else "yyyy-MM-dd")


def parse_date(c: Column) -> Column:
    """``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm:ss`` in full, else null."""
    day, second = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
    return F.when(c.rlike(second), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))).when(c.rlike(day), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def upper_bound(c: Column) -> Column:
    """The exclusive upper bound that a date (its whole day) or a time means."""
    at = parse_date(c)
    return F.when(F.length(c) == 10, at + F.expr("INTERVAL 1 DAY")).otherwise(at)


def jalali(d: Column) -> Column:
    """struct<year, month, day> of the Persian calendar, by days since an epoch of its 33-year cycles."""
    # 1 Farvardin 979 is 1600-03-20 (proleptic); a cycle of 33 years has 12053 days, 8 of them leap years
    days = F.datediff(d, F.lit("1600-03-20").cast("date"))
    cycle, rest = F.floor(days / 12053), F.pmod(days, F.lit(12053))
    year = 979 + 33 * cycle + 4 * F.floor(rest / 1461)
    left = rest % 1461
    more = F.when(left >= 366, F.floor((left - 1) / 365)).otherwise(0)
    year, left = year + more, F.when(left >= 366, (left - 1) % 365).otherwise(left)
    month = F.when(left < 186, 1 + F.floor(left / 31)).otherwise(7 + F.floor((left - 186) / 30))
    day = F.when(left < 186, 1 + left % 31).otherwise(1 + (left - 186) % 30)
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"))


def pct(part: Column, whole: Column) -> Column:
    """M1: per cent to one decimal; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, 1))


def pct_or_null(part: Column, whole: Column) -> Column:
    """As ``pct``, but null of nothing."""
    return F.when(whole != 0, F.round(100.0 * part / whole, 1))


def is_generic(token: Column, df: Column, n: Column, ratio: float, stopwords: tuple[str, ...] = ()) -> Column:
    """M3: a stop word, or in more than ``ratio`` of all products; digits never."""
    stop = token.isin(*stopwords) if stopwords else F.lit(False)
    common = (n > 0) & F.lit(ratio > 0) & (df / n > ratio)
    return ~token.rlike("^[0-9]+$") & (stop | common)


def idf_weight(df: Column, n: Column, generic: Column) -> Column:
    """M2: 0.1 for generic tokens, else ln(n / (1 + df)) / ln n within 0.2 and 1; 1 below three products."""
    idf = F.ln(n / (1 + df)) / F.ln(n)
    return F.when(generic, 0.1).when(n < 3, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.2), idf)))


def cap_heaviest(weights: Column) -> Column:
    """M4: among several weights the first largest one counts at most as much as all others together."""
    top = F.array_max(weights)
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    at = F.array_position(weights, top) - 1
    return F.when(F.size(weights) > 1, F.transform(weights, lambda w, i: F.when(i == at, F.least(w, total - top)).otherwise(w))).otherwise(weights)


def dot(a: Column, b: Column) -> Column:
    """M6: the products' sum in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """M5: the vector by its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def nearest_rank(c: Column, p: float) -> Column:
    """The nearest-rank percentile: a value of the group."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c._jc.toString()})").cast("double")
