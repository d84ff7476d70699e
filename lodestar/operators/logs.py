"""Search-log rows: which count as searches, flags by what came before, masking, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_digits

DUPLICATE_SECONDS, BURST_SECONDS, BURST_ROWS, REPEAT_SECONDS = 120, 60, 3, 5


def with_defaults(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> tuple[DataFrame, set[str]]:
    """``df`` with missing columns as typed literals, and the names that were there."""
    present = set(df.columns)
    return df.withColumns({n: F.lit(v).cast(t) for n, (t, v) in defaults.items() if n not in present}), present


def query_key(collation: str | None = None) -> Column:
    """The normalized query, or the raw one where that is empty."""
    key = F.coalesce(F.nullif("normalized_q", F.lit("")), F.col("raw_q"))
    return F.collate(key, collation) if collation else key


def searches(logs: DataFrame) -> DataFrame:
    """The rows that are searches: first pages typed by a shopper, neither repeated, in a burst nor suspicious.

    A condition on a column that the log doesn't have yet is dropped.
    """
    rules = {
        "is_duplicate": lambda: ~F.col("is_duplicate"), "page": lambda: F.col("page") == 1, "source": lambda: F.col("source") != "filter",
        "is_burst": lambda: ~F.col("is_burst"), "is_suspicious": lambda: ~F.col("is_suspicious"),
    }
    return reduce(lambda d, n: d.where(rules[n]()) if n in logs.columns else d, rules, logs)


def second_version(logs: DataFrame) -> DataFrame:
    """Rows of the newer log format that aren't suspicious, searches or not."""
    return logs.where((F.col("log_version") == 2) & ~F.col("is_suspicious"))


def within(df: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows of [start, end)."""
    if start is not None:
        df = df.where(F.col("ts") >= start)
    return df if end is None else df.where(F.col("ts") < end)


def flag_duplicates(logs: DataFrame, seconds: int = DUPLICATE_SECONDS) -> DataFrame:
    """Adds is_duplicate: the same session asked the same for the same page within ``seconds`` before; never without a session."""
    w = Window.partitionBy("session_id", "normalized_q", "page").orderBy("ts", "id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return logs.withColumn("is_duplicate", F.coalesce(F.col("session_id").isNotNull() & (gap <= seconds * 1_000_000), F.lit(False)))


def flag_bursts(logs: DataFrame, seconds: int = BURST_SECONDS, rows: int = BURST_ROWS) -> DataFrame:
    """Adds is_burst: at least ``rows`` identical first-page rows within ``seconds`` before, by session, or by query without one.

    The ``rows``-th row before decides: if it is recent enough, so are those between.
    """
    w = Window.partitionBy("session_id", "normalized_q", F.col("page") == 1).orderBy("ts", "id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts", rows).over(w).cast("timestamp"))
    return logs.withColumn("is_burst", F.coalesce((F.col("page") == 1) & (gap <= seconds * 1_000_000), F.lit(False)))


def dedupe_events(events: DataFrame, logs: DataFrame, seconds: int = REPEAT_SECONDS) -> DataFrame:
    """Click events of known searches without repeats of the same action on the same product within ``seconds`` of the row before."""
    known = events.where(F.col("action").isin("click", "dym_click")).join(logs.select("search_uuid").distinct(), "search_uuid", "left_semi")
    w = Window.partitionBy("search_uuid", "product_id", "action").orderBy("ts", "id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return known.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") > seconds * 1_000_000)).drop("gap")


def masked(logs: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Rows as they're written: digits masked, texts cut."""
    limits = limits or {"raw_q": 512, "normalized_q": 190, "error": 120}
    return logs.withColumns({c: F.substring(mask_digits(c), 1, n) for c, n in limits.items() if c in logs.columns})


def retained(df: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Rows not older than ``days``."""
    return df.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def cache_lifetime(lookups: DataFrame, hot: int = 20, days: int = 7) -> DataFrame:
    """Seconds each lookup's answer would live: a week for keys looked up ``hot`` times in seven days, else a day; empty answers five minutes."""
    # running sums in which a lookup counts from its time on, until the span after it is over
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = lookups.withColumns({"_at": at, "_n": F.lit(1)})
    over = rows.where("_at is not null").withColumns({"_at": F.col("_at") + days * 86400 + 1, "_n": F.lit(-1)})
    w = Window.partitionBy("key", F.col("_at").isNull()).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.unionAll(over).withColumn("lookups", F.sum("_n").over(w)).where("_n > 0").drop("_at", "_n")
    return rows.withColumn("ttl", F.when(F.col("empty"), 300).when(F.col("lookups") >= hot, 7 * 86400).otherwise(86400))


def top_ids(c: str) -> Column:
    """The ids of a comma list."""
    return F.transform(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: x != ""), lambda x: x.cast("long"))
