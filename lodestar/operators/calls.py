"""Reports over the calls to the vector service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pct_or_null
from .analytics import rank_value

#: The outcomes of a call, and those that are no failures.
OUTCOMES = ("ok", "timeout", "dns", "connect", "http", "malformed", "error", "not_configured", "skipped")
FINE = ("ok", "not_configured", "skipped")
NEAR_TIMEOUT, GAP_SECONDS, INCIDENTS, AROUND = 0.8, 60, 50, 10


def failures(calls: DataFrame) -> DataFrame:
    return calls.where(~F.col("outcome").isin(*FINE))


def summary(calls: DataFrame) -> DataFrame:
    """A row per kind: outcomes, share answered, percentiles, calls near their timeout. Skipped calls count apart."""
    count = lambda c: F.count_if(c)
    made = F.count_if(F.col("outcome") != "skipped")
    ok = count(F.col("outcome") == "ok")
    near = count((F.col("outcome") == "ok") & (F.col("timeout_ms") > 0) & (F.col("duration_ms") > F.col("timeout_ms") * NEAR_TIMEOUT))
    each = [count(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES]
    return calls.groupBy("kind").agg(made.alias("calls"), *each, pct_or_null(ok, made).alias("ok_pct"), rank_value("duration_ms", 0.5).alias("p50"), rank_value("duration_ms", 0.95).alias("p95"), F.max("duration_ms").alias("max_ms"), near.alias("near"), pct_or_null(near, made).alias("near_pct"))


def hourly(calls: DataFrame) -> DataFrame:
    """Calls and failures of every hour between the first and the last, empty ones too."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    counts = calls.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("outcome").isin(*FINE)).alias("failed"))
    spine = calls.agg(F.min(hour).alias("a"), F.max(hour).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    full = spine.join(counts, "hour", "left")
    return full.select(F.date_format("hour", "yyyy-MM-dd HH:00").alias("hour"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("failed", F.lit(0)).alias("failed"))


def incidents(calls: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Failures within ``gap`` seconds of each other as one incident: first, last, count, kinds in the order they came."""
    failed = failures(calls)
    sessions = failed.groupBy(F.session_window(F.col("ts").cast("timestamp"), f"{gap} seconds").alias("w"))
    first = F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "kind"))), lambda x: x["kind"])
    grouped = sessions.agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_distinct(first), ",").alias("kinds"))
    return grouped.drop("w")


def baselines(calls: DataFrame, gap: int = GAP_SECONDS, limit: int = INCIDENTS, around: int = AROUND) -> DataFrame:
    """Median duration of the ``around`` answered searches before and after each of the newest incidents."""
    newest = incidents(calls, gap).orderBy(F.desc("start")).limit(limit)
    ok = calls.where("kind = 'search' and outcome = 'ok' and duration_ms is not null").select(F.col("ts").alias("at"), F.col("id").alias("call"), "duration_ms")
    few = F.broadcast(newest)  # ``limit`` rows at most
    out = newest.select("start", "end", "n")
    for name, met, order in (("before_ms", F.col("at") < F.col("start"), F.desc("at")), ("after_ms", F.col("at") > F.col("end"), F.asc("at"))):
        near = ok.join(few.select("start", "end"), met).withColumn("r", F.row_number().over(Window.partitionBy("start").orderBy(order, "call"))).where(F.col("r") <= around)
        out = out.join(near.groupBy("start").agg(F.round(F.median("duration_ms")).cast("long").alias(name)), "start", "left")
    return out


def view(calls: DataFrame, name: str, outcome: str | None = None, kind: str | None = None, start=None, end=None) -> DataFrame:
    """The failures, the slowest calls or all of them, by closed lists of outcomes and kinds."""
    if name not in ("failures", "slowest", "all") or outcome not in (None, *OUTCOMES) or kind not in (None, "search", "probe", "reload"):
        raise ValueError("unknown view, outcome or kind")
    rows = failures(calls) if name == "failures" else calls
    for c, v in (("outcome", outcome), ("kind", kind)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    rows = rows if start is None else rows.where(F.col("ts") >= start)
    rows = rows if end is None else rows.where(F.col("ts") < end)
    return rows.orderBy(F.desc_nulls_last("duration_ms"), F.desc("id")) if name == "slowest" else rows.orderBy(F.desc("id"))


def safe_export(calls: DataFrame, limit: int = 50_000) -> DataFrame:
    """Rows for a spreadsheet: texts that it would take for formulas get an apostrophe."""
    safe = lambda c: F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c))
    rows = calls.orderBy(F.desc("id")).limit(limit)
    return rows.select(*(safe(c).alias(c) if t == "string" else c for c, t in calls.dtypes))
