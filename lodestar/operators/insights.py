"""Reports over the second version of the search log, with clicks: engagement, suggestions, gaps, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bucket, pct
from .analytics import by_query, rank_value, top_queries
from .logs import query_key, searches, second_version


def click_summary(events: DataFrame) -> DataFrame:
    """(search_uuid, clicks, first_position) of searches with a click."""
    clicks = events.where("action = 'click'")
    return clicks.groupBy("search_uuid").agg(F.count(F.lit(1)).alias("clicks"), F.min(F.greatest("position", F.lit(1))).alias("first_position"))


def _with_clicks(logs: DataFrame, events: DataFrame) -> DataFrame:
    return searches(second_version(logs)).join(click_summary(events), "search_uuid", "left")


def engagement(logs: DataFrame, events: DataFrame) -> DataFrame:
    rows = _with_clicks(logs, events).where("result_count > 0")
    n, clicked = F.count(F.lit(1)), F.count("clicks")
    mrr = F.when(n == 0, 0.0).otherwise(F.round(F.coalesce(F.sum(1.0 / F.col("first_position")), F.lit(0.0)) / n, 4))
    return rows.agg(n.alias("n"), clicked.alias("clicked"), pct(clicked, n).alias("ctr"), pct(n - clicked, n).alias("no_click_pct"), mrr.alias("mrr"), F.round(F.avg("first_position"), 2).alias("mean_position"))


def cold_latency(logs: DataFrame) -> DataFrame:
    """Latencies of requests that no cache answered, and of their stages; repeated rows count too."""
    cold = second_version(logs).where("not cache_hit")
    return cold.agg(F.count(F.lit(1)).alias("n"), rank_value("latency_ms", 0.5).alias("p50"), rank_value("latency_ms", 0.95).alias("p95"), F.max("latency_ms").alias("max_ms"),
                    rank_value("lat_keyword_ms", 0.95).alias("keyword_p95"), rank_value("lat_vector_ms", 0.95, "lat_vector_ms IS NOT NULL").alias("vector_p95"))


def tier_outages(logs: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive hours with searches but without any hybrid answer; none if nothing was ever hybrid."""
    hours = searches(second_version(logs)).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "hybrid").alias("hybrid"))
    # one row an hour: a small table
    down = hours.withColumn("ever", F.sum("hybrid").over(Window.partitionBy()) > 0).where((F.col("n") >= least) & (F.col("hybrid") == 0) & F.col("ever"))
    number = F.floor(F.unix_seconds(F.col("hour").cast("timestamp")) / 3600) - F.row_number().over(Window.orderBy("hour"))
    runs = down.withColumn("run", number).groupBy("run").agg(F.min("hour").alias("start"), F.max("hour").alias("end"), F.count(F.lit(1)).alias("hours"), F.sum("n").alias("searches"))
    return runs.select(F.date_format("start", "yyyy-MM-dd HH:00").alias("start"), F.date_format("end", "yyyy-MM-dd HH:00").alias("end"), "hours", "searches")


def capped_share(logs: DataFrame) -> DataFrame:
    n, capped = F.count(F.lit(1)), F.count_if("is_capped")
    return second_version(logs).agg(n.alias("n"), capped.alias("capped"), pct(capped, n).alias("capped_pct"))


def suggestion_pairs(logs: DataFrame, events: DataFrame, limit: int = 20) -> DataFrame:
    """How often each suggestion was shown for a query, and clicked."""
    clicks = events.where("action = 'dym_click'").groupBy("search_uuid").agg(F.count(F.lit(1)).alias("n"))
    shown = searches(second_version(logs)).where("did_you_mean <> ''").withColumn("q", query_key()).join(clicks, "search_uuid", "left")
    pairs = shown.groupBy("q", "did_you_mean").agg(F.count(F.lit(1)).alias("shown"), F.count("n").alias("clicked"))
    return pairs.withColumn("ctr", pct(F.col("clicked"), F.col("shown"))).orderBy(F.desc("shown"), "q", "did_you_mean").limit(limit)


def zero_suggestions(logs: DataFrame) -> DataFrame:
    """Distinct suggestions that found nothing themselves when searched."""
    rows = searches(second_version(logs))
    shown = rows.where("did_you_mean <> ''").select("did_you_mean").distinct()
    zero = rows.where("result_count = 0").select(F.col("normalized_q").alias("did_you_mean"))
    return shown.join(zero, "did_you_mean", "left_semi").agg(F.count(F.lit(1)).alias("zero_suggestions"))


def follow_ups(logs: DataFrame, seconds: int = 60) -> DataFrame:
    """(id, q, next_id, next_q, next_uuid) of searches without results and the session's next search with some, of another query, within ``seconds``.

    One pass over each session in time order: the next row that qualifies is the first following one with results whose query differs.
    """
    rows = searches(second_version(logs)).where("session_id is not null")
    a = rows.where("result_count = 0").select("session_id", F.col("id").alias("a_id"), F.col("ts").alias("a_ts"), F.col("normalized_q").alias("a_q"), query_key().alias("q"))
    b = rows.where("result_count > 0").select("session_id", F.col("id").alias("b_id"), F.col("ts").alias("b_ts"), F.col("normalized_q").alias("b_q"), query_key().alias("next_q"), "search_uuid")
    # by slots of the interval, so that only neighbours in time meet: a row and those of its own and the next slot
    slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / max(1, seconds))
    a = a.withColumn("slot", F.explode(F.array(slot("a_ts"), slot("a_ts") + 1)))
    b = b.withColumn("slot", slot("b_ts"))
    met = a.join(b, ["session_id", "slot"]).where((F.col("b_id") > F.col("a_id")) & (F.col("b_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col("b_q") != F.col("a_q")))
    first = met.groupBy("a_id", "q").agg(F.min(F.struct("b_id", "next_q", "search_uuid")).alias("n"))
    return first.select(F.col("a_id").alias("id"), "q", F.col("n.b_id").alias("next_id"), F.col("n.next_q").alias("next_q"), F.col("n.search_uuid").alias("next_uuid"))


def alias_pairs(logs: DataFrame, events: DataFrame, seconds: int = 60, limit: int = 20) -> DataFrame:
    """Candidates for aliases: the query without results and what was asked next, with clicks on the latter."""
    clicked = events.where("action = 'click'").select(F.col("search_uuid").alias("next_uuid"), F.lit(1).alias("hit")).distinct()
    pairs = follow_ups(logs, seconds).join(clicked, "next_uuid", "left").groupBy("q", "next_q").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("clicks"))
    return pairs.orderBy(F.desc("clicks"), F.desc("pairs"), "q", "next_q").limit(limit)


def silent_failures(logs: DataFrame, events: DataFrame, least: int = 5, most_ctr: float = 2.0) -> DataFrame:
    """Queries with results that hardly anyone clicks; none unless clicks are tracked at all."""
    rows = _with_clicks(logs, events).where("result_count > 0").withColumn("q", query_key()).where("q <> ''")
    tracked = events.where("action = 'click'").limit(1).select(F.lit(1).alias("tracked"))
    grouped = rows.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count("clicks").alias("clicked")).withColumn("ctr", pct(F.col("clicked"), F.col("n")))
    return grouped.where((F.col("n") >= least) & (F.col("ctr") <= most_ctr)).join(F.broadcast(tracked)).drop("tracked")


def brand_unmatched(logs: DataFrame) -> DataFrame:
    rows = searches(second_version(logs)).where("brand_unmatched <> ''").withColumn("brand", F.explode(F.split("brand_unmatched", ",")))
    return rows.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.max(query_key()).alias("example"), F.max("ts").alias("last_seen"))


def demand_gap(logs: DataFrame, seconds: int = 60) -> DataFrame:
    """Queries without results that no alias candidate explains."""
    zero = by_query(searches(second_version(logs)).where("result_count = 0"))
    return zero.join(follow_ups(logs, seconds).select("q").distinct(), "q", "left_anti").select("q", "searches")


def trending(logs: DataFrame, start, previous, least: int = 3, now: int = 500, before: int = 5000) -> DataFrame:
    """Queries that were asked more often since ``start`` than in the window from ``previous`` to it."""
    current = top_queries(logs.where(F.col("ts") >= start), now).select("q", "searches")
    past = top_queries(logs.where((F.col("ts") >= previous) & (F.col("ts") < start)), before).select("q", F.col("searches").alias("before"))
    both = current.join(past, "q", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return both.where((F.col("searches") >= least) & (F.col("searches") > F.col("before"))).withColumn("growth", F.col("searches") - F.col("before"))


def suspicious(logs: DataFrame, samples: int = 10) -> DataFrame:
    """The newest suspicious rows, cut to 120 characters, with the count of all."""
    rows = logs.where("is_suspicious")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(samples).select("id", F.substring("raw_q", 1, 120).alias("raw_q")).join(F.broadcast(total))


def compare(logs: DataFrame, start, previous) -> DataFrame:
    """Searches and zero results since ``start`` and in the window before, with the change; per cent null on nothing."""
    rows = searches(logs).where(F.col("ts") >= previous)
    now, was = F.col("ts") >= start, F.col("ts") < start
    wide = rows.agg(F.count_if(now).alias("searches"), F.count_if(was).alias("searches_before"), F.count_if(now & (F.col("result_count") == 0)).alias("zero"), F.count_if(was & (F.col("result_count") == 0)).alias("zero_before"))
    change = lambda a: (F.col(a) - F.col(f"{a}_before"))
    return wide.select("*", change("searches").alias("change"), F.when(F.col("searches_before") != 0, F.round(100.0 * change("searches") / F.col("searches_before"), 1)).alias("change_pct"))


def latest_results(logs: DataFrame, products: DataFrame) -> DataFrame:
    """The newest search of each query and the title of its first product."""
    latest = searches(logs).withColumn("q", query_key()).groupBy("q").agg(F.max_by("product_id", F.struct("ts", "id")).alias("product_id"))
    return latest.join(products.select("product_id", "title"), "product_id", "left").select("q", "product_id", "title")


def hours_present(ts, unit: str = "hour"):
    return bucket(ts, unit)
