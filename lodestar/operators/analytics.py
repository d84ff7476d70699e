"""Reports over the search log. Percentiles are nearest-rank, shares have one decimal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket, pct
from ..functions.text import length_bucket, tokenize
from .logs import query_key, searches

HISTORY = {"day": 366, "hour": 744}


def rank_value(column: str, p: float, where: str | None = None) -> Column:
    """The nearest-rank percentile of a column, as double."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})" + (f" FILTER (WHERE {where})" if where else "")).cast("double")


def result_health(logs: DataFrame) -> DataFrame:
    n, zero = F.count(F.lit(1)), F.count_if(F.col("result_count") == 0)
    return searches(logs).agg(n.alias("searches"), zero.alias("zero"), pct(zero, n).alias("zero_pct"), F.round(F.coalesce(F.avg("result_count"), F.lit(0.0)), 1).alias("avg_results"))


def by_query(rows: DataFrame) -> DataFrame:
    """(q, searches, last_seen) of each query; rows without one don't count."""
    keyed = rows.withColumn("q", query_key()).where((F.col("q") != ""))
    return keyed.groupBy("q").agg(F.count(F.lit(1)).alias("searches"), F.max("ts").alias("last_seen"))


def top_queries(logs: DataFrame, limit: int | None = 20) -> DataFrame:
    out = by_query(searches(logs)).orderBy(F.desc("searches"), F.desc("last_seen"), "q")
    return out.limit(limit) if limit else out


def zero_queries(logs: DataFrame, limit: int = 20) -> DataFrame:
    return top_queries(logs.where("result_count = 0"), limit)


def grouped_export(logs: DataFrame) -> DataFrame:
    """All rows by query, searches or not, for export."""
    return by_query(logs)


def cache_stats(logs: DataFrame) -> DataFrame:
    n, hits = F.count(F.lit(1)), F.count_if("cache_hit")
    return searches(logs).agg(hits.alias("hits"), (n - hits).alias("misses"), pct(hits, n).alias("hit_pct"))


def tier_stats(logs: DataFrame) -> DataFrame:
    n, hybrid = F.count(F.lit(1)), F.count_if(F.col("tier") == "hybrid")
    return searches(logs).agg(n.alias("searches"), hybrid.alias("hybrid"), (n - hybrid).alias("keyword_only"), pct(hybrid, n).alias("hybrid_pct"))


def latency(logs: DataFrame) -> DataFrame:
    return searches(logs).agg(F.count("latency_ms").alias("n"), F.round(F.avg("latency_ms"), 1).alias("avg_ms"), rank_value("latency_ms", 0.5).alias("p50"), rank_value("latency_ms", 0.95).alias("p95"), F.max("latency_ms").alias("max_ms"))


def suggestion_share(logs: DataFrame) -> DataFrame:
    n, shown = F.count(F.lit(1)), F.count_if(F.coalesce(F.col("did_you_mean"), F.lit("")) != "")
    return searches(logs).agg(n.alias("searches"), shown.alias("shown"), pct(shown, n).alias("shown_pct"))


def unique_searches(logs: DataFrame) -> DataFrame:
    n, sessions = F.count(F.lit(1)), F.count_distinct("session_id")
    with_session = F.count("session_id")
    return searches(logs).agg(n.alias("unique_searches"), sessions.alias("sessions"), F.when(sessions == 0, 0.0).otherwise(F.round(with_session / sessions, 2)).alias("per_session"), pct(F.count_if(F.col("result_count") == 0), n).alias("zero_pct"))


def repeat_rate(logs: DataFrame) -> DataFrame:
    """Share of searches whose query was asked more than once."""
    repeated = F.coalesce(F.sum(F.when(F.col("searches") > 1, F.col("searches"))), F.lit(0))
    total = F.coalesce(F.sum("searches"), F.lit(0))
    return by_query(searches(logs)).agg(total.alias("searches"), repeated.alias("repeated"), pct(repeated, total).alias("repeat_pct"))


def requests(logs: DataFrame) -> DataFrame:
    flagged = logs.join(searches(logs).select("id", F.lit(True).alias("ok")), "id", "left")
    n, ok = F.count(F.lit(1)), F.count("ok")
    return flagged.agg(n.alias("requests"), ok.alias("searches"), (n - ok).alias("filtered"))


def length_histogram(logs: DataFrame) -> DataFrame:
    """Searches by words of the query, 1 to 5 and more, every bucket present."""
    counts = searches(logs).withColumn("words", length_bucket(query_key())).groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    spine = logs.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("words"))
    return spine.join(counts, "words", "left").select("words", F.coalesce("n", F.lit(0)).alias("n"))


def top_names(logs: DataFrame, products: DataFrame, column: str, limit: int = 20, queries: int = 1000) -> DataFrame:
    """Search volume of the catalog names (brands, categories) whose words are all in the query, over the most frequent queries."""
    names = products.select(F.col(column).alias("name")).where("name <> ''").distinct()
    names = names.withColumn("word", F.explode(F.array_distinct(tokenize(F.lower("name")))))
    sizes = names.groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    asked = top_queries(logs, queries).select("q", "searches", F.explode(F.array_distinct(tokenize(F.lower("q")))).alias("word"))
    whole = asked.join(names, "word").groupBy("q", "searches", "name").agg(F.count(F.lit(1)).alias("held")).join(sizes, "name").where("held = size")
    return whole.groupBy("name").agg(F.sum("searches").alias("searches")).orderBy(F.desc("searches"), "name").limit(limit)


def volume(logs: DataFrame, unit: str = "day") -> DataFrame:
    """Searches of the newest buckets, oldest first."""
    counts = searches(logs).groupBy(bucket(F.col("ts"), unit).alias("bucket")).agg(F.count(F.lit(1)).alias("searches"))
    return counts.orderBy(F.desc("bucket")).limit(HISTORY[unit]).orderBy("bucket")


def zero_trend(logs: DataFrame, low: int = 30) -> DataFrame:
    """Zero rate of each day, and pooled over the last seven days that had searches."""
    days = searches(logs).groupBy(bucket(F.col("ts"), "day").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result_count") == 0).alias("zero"))
    w = Window.orderBy("bucket").rowsBetween(-6, 0)  # one row a day: a small table
    return days.select("bucket", "n", "zero", pct(F.col("zero"), F.col("n")).alias("zero_pct"), pct(F.sum("zero").over(w), F.sum("n").over(w)).alias("moving_pct"), (F.col("n") < low).alias("low_confidence"))


def latency_trend(logs: DataFrame, unit: str = "day") -> DataFrame:
    return searches(logs).groupBy(bucket(F.col("ts"), unit).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), rank_value("latency_ms", 0.95).alias("p95"))


def heatmap(logs: DataFrame) -> DataFrame:
    return searches(logs).groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("searches"))
