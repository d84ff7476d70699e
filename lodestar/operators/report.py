"""The named reports over the search log, from one read of it.

Every row says what it counts for: itself, its day, its hour, its query, its latency and so on. One
aggregation by these pairs, combined before it shuffles, gives a table that is small next to the log;
all reports are made from it, percentiles from the counts of each value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket, pct
from ..functions.text import length_bucket
from .analytics import HISTORY
from .lexicon import kept
from .logs import query_key

TOP = 20


def counted(logs: DataFrame) -> DataFrame:
    """Stored: (kind, key, value, n, zero, hits, hybrid, shown, results, capped, last) of everything that rows count for; one scan of ``logs``."""
    search, second = search_test(logs), (F.col("log_version") == 2) & ~F.col("is_suspicious")
    q, day = query_key(), bucket(F.col("ts"), "day")
    none = F.lit(None).cast("long")
    mark = lambda test, kind, key="", value=none: F.when(test, F.struct(F.lit(kind).alias("kind"), (F.lit(key) if isinstance(key, str) else key).alias("key"), value.cast("long").alias("value")))
    latency = lambda column: F.col(column).cast("long")
    cold, zero = second & ~F.col("cache_hit"), F.col("result_count") == 0
    brands = F.transform(F.split(F.coalesce("brand_unmatched", F.lit("")), ","), lambda b: mark(search & second & (b != ""), "brand", b))
    marks = F.concat(F.array(
        mark(F.lit(True), "request"), mark(search, "search"), mark(search, "day", day), mark(search, "hour", bucket(F.col("ts"), "hour")), mark(search, "heat", F.concat_ws(" ", F.weekday("ts").cast("string"), F.hour("ts").cast("string"))),
        mark(search, "words", length_bucket(q).cast("string")), mark(search & (q != ""), "query", q), mark(search & zero & (q != ""), "zero query", q), mark(search & F.col("session_id").isNotNull(), "session", F.col("session_id")),
        mark(search & latency("latency_ms").isNotNull(), "latency", "", latency("latency_ms")), mark(search & latency("latency_ms").isNotNull(), "day latency", day, latency("latency_ms")),
        mark(second, "second"), mark(cold, "cold"), mark(cold & latency("latency_ms").isNotNull(), "cold latency", "", latency("latency_ms")),
    ), brands)
    has = lambda test: F.count_if(test)
    each = logs.select("*", F.inline(F.filter(marks, lambda m: m.isNotNull())))
    return kept(each.groupBy("kind", "key", "value").agg(
        F.count(F.lit(1)).alias("n"), has(zero).alias("zero"), has(F.col("cache_hit")).alias("hits"), has(F.col("tier") == "hybrid").alias("hybrid"), has(F.coalesce("did_you_mean", F.lit("")) != "").alias("shown"),
        F.sum(F.col("result_count").cast("decimal(20,0)")).cast("double").alias("results"), has(F.col("is_capped")).alias("capped"), F.max("ts").alias("last"),
    ), "report-counts")


def search_test(logs: DataFrame) -> Column:
    """The condition of ``searches`` on each row of ``logs``."""
    rules = {"is_duplicate": lambda: ~F.col("is_duplicate"), "page": lambda: F.col("page") == 1, "source": lambda: F.col("source") != "filter", "is_burst": lambda: ~F.col("is_burst"), "is_suspicious": lambda: ~F.col("is_suspicious")}
    return F.coalesce(reduce(lambda a, b: a & b, (test() for name, test in rules.items() if name in logs.columns), F.lit(True)), F.lit(False))


def _percentiles(counts: DataFrame, kind: str) -> DataFrame:
    """(key, n, total, p50, p95, most) of the values of a kind, by nearest rank."""
    rows = counts.where(F.col("kind") == kind)
    w = Window.partitionBy("key").orderBy("value")
    rows = rows.withColumn("up_to", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("key")))
    at = lambda p: F.min(F.when(F.col("up_to") >= p * F.col("all"), F.col("value"))).cast("double")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("total"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("value").alias("most"))


def report(logs: DataFrame, top: int = TOP, low: int = 6) -> DataFrame:
    """(report, key, value): nineteen named reports; a value of nothing is 0, a percentile or mean of nothing null.

    The moving zero rate pools a day with the ``low`` days with searches before it.
    """
    counts = counted(logs)
    of = lambda kind: counts.where(F.col("kind") == kind)
    n, zero = F.col("n"), F.col("zero")

    def named(rows: DataFrame, **reports: dict[str, Column]) -> DataFrame:
        cells = [F.struct(F.lit(r).alias("report"), F.lit(k).alias("key"), c.cast("double").alias("value")) for r, some in reports.items() for k, c in some.items()]
        return rows.select(F.inline(F.array(*cells)))

    by_key = lambda rows, name, value=n: rows.select(F.lit(name).alias("report"), "key", value.cast("double").alias("value"))
    total = lambda kind, *what: of(kind).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in what))
    all_ = total("search", "n", "zero", "hits", "hybrid", "shown", "results")
    sessions = of("session").agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("with_session"))
    repeats = of("query").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("repeated"))
    requests = total("request", "n").join(F.broadcast(all_.select(n.alias("ok"))))  # one row
    timed = lambda kind: _percentiles(counts, kind)
    newest = lambda kind, unit: of(kind).orderBy(F.desc("key")).limit(HISTORY[unit])
    best = lambda kind: of(kind).orderBy(F.desc("n"), F.desc("last"), "key").limit(top)
    week = Window.orderBy("key").rowsBetween(-low, 0)  # a row a day
    moving = of("day").select("key", pct(F.sum("zero").over(week), F.sum("n").over(week)).alias("value"))
    lengths = logs.sparkSession.range(1, 6).select(F.col("id").cast("string").alias("key")).join(of("words").select("key", "n"), "key", "left").fillna(0, ["n"])
    parts = [
        named(
            all_, summary={"searches": n, "zero": zero, "zero_pct": pct(zero, n), "avg_results": F.round(F.coalesce(F.try_divide("results", "n"), F.lit(0.0)), 1)},
            cache={"hits": F.col("hits"), "misses": n - F.col("hits"), "hit_pct": pct(F.col("hits"), n)}, tier={"hybrid": F.col("hybrid"), "keyword_only": n - F.col("hybrid"), "hybrid_pct": pct(F.col("hybrid"), n)},
            did_you_mean={"shown": F.col("shown"), "shown_pct": pct(F.col("shown"), n)},
        ),
        named(sessions, unique={"sessions": F.col("sessions"), "per_session": F.when(F.col("sessions") == 0, 0.0).otherwise(F.round(F.try_divide("with_session", "sessions"), 2))}),
        named(repeats, repeat_queries={"searches": n, "repeated": F.col("repeated"), "repeat_pct": pct(F.col("repeated"), n)}),
        named(requests, requests={"requests": n, "searches": F.col("ok"), "filtered": n - F.col("ok")}),
        named(timed("latency"), latency={"n": n, "avg_ms": F.round(F.col("total") / n, 1), "p50": F.col("p50"), "p95": F.col("p95"), "max_ms": F.col("most")}),
        named(timed("cold latency"), latency_cold={"p50": F.col("p50"), "p95": F.col("p95"), "max_ms": F.col("most")}), named(total("cold", "n"), latency_cold={"n": n}),
        named(total("second", "n", "capped"), capped_share={"n": n, "capped": F.col("capped"), "capped_pct": pct(F.col("capped"), n)}),
        by_key(newest("day", "day"), "volume"), by_key(newest("hour", "hour"), "volume_hourly"), by_key(of("day"), "zero_rate_trend", pct(zero, n)), by_key(moving, "zero_rate_moving", F.col("value")),
        by_key(timed("day latency"), "latency_trend", F.col("p95")), by_key(of("heat"), "hourly_heatmap"), by_key(lengths, "query_length"), by_key(best("query"), "top_queries"), by_key(best("zero query"), "zero_result_queries"),
        by_key(of("brand"), "brand_unmatched"),
    ]
    return reduce(DataFrame.unionByName, parts)
