"""Queries over the search log, its events and the service calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import audit as U
from ..operators import calls as C
from ..operators import insights as I
from ..operators import logs as L
from ..operators.lexicon import kept
from ..operators.paging import SORTS, clustered, log_page
from ..operators.report import report
from .views import view, with_views

FOLLOW_SECONDS = 600  # events of the driver's tables lie minutes apart
AT, BEFORE = "2024-01-20 00:00:00", "2024-01-10 00:00:00"

SEARCHES = "s AS (SELECT *, coalesce(nullif(normalized_q, ''), raw_q) AS q FROM search_logs_v WHERE page = 1 AND source <> 'filter' AND NOT is_suspicious)"
V2 = "v AS (SELECT * FROM s WHERE log_version = 2)"
V2_ALL = "w AS (SELECT * FROM search_logs_v WHERE log_version = 2 AND NOT is_suspicious)"
CLICKS = "c AS (SELECT search_uuid, count(*) AS clicks, min(greatest(position, 1)) AS first_position FROM search_events_v WHERE action = 'click' GROUP BY search_uuid)"
FOLLOW = f"""f AS (
    SELECT a.id, a.q, min(b.id) AS next_id FROM v a JOIN v b ON b.session_id = a.session_id AND b.id > a.id AND b.ts <= a.ts + INTERVAL {FOLLOW_SECONDS} SECONDS
    AND b.result_count > 0 AND b.normalized_q <> a.normalized_q WHERE a.result_count = 0 GROUP BY a.id, a.q)"""


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round(100.0 * {part} / {whole}, 1) END"


def _disc(p: float, c: str, where: str = "") -> str:
    return f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY {c}){where} AS double)"


def _ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _log(f):
    return lambda spark, d: f(view(spark, d, "search_logs_v"))


def _log_events(f):
    return lambda spark, d: f(view(spark, d, "search_logs_v"), view(spark, d, "search_events_v"))


def _calls(f):
    return lambda spark, d: f(view(spark, d, "calls_v"))


def _masked(spark: SparkSession, d: str) -> DataFrame:
    logs = view(spark, d, "search_logs_v").withColumn("raw_q", F.concat("raw_q", F.lit(" "), (F.col("id") * 100003).cast("string")))
    return L.masked(logs).select("id", "raw_q")


def _retained(spark: SparkSession, d: str) -> DataFrame:
    calls = view(spark, d, "calls_v")
    return L.retained(calls, calls.agg(F.max("ts")).scalar(), 10).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _lifetimes(spark: SparkSession, d: str) -> DataFrame:
    logs = view(spark, d, "search_logs_v").select("id", "ts", L.query_key().alias("key"), (F.col("result_count") == 0).alias("empty"))
    return L.cache_lifetime(logs, hot=30).groupBy("ttl").agg(F.count(F.lit(1)).alias("n"), F.max("lookups").alias("most"))


def _page(spark: SparkSession, d: str) -> DataFrame:
    logs = view(spark, d, "search_logs_v")
    newest = logs.where(F.col("id") > logs.agg(F.max("id")).scalar() - 5000)
    found = newest.where(F.contains("raw_q", F.lit("gear")) | F.contains("normalized_q", F.lit("gear"))).where("result_count = 0")
    return found.orderBy(F.desc("id")).offset(20).limit(20).select("id", "raw_q", "latency_ms")


#: Pages: view, sort, direction, term, page.
PAGES = (("recent", "", "", "", 1), ("recent", "", "", "", 3), ("recent", "raw_q", "", "GEAR", 2), ("zero", "", "", "red", 1), ("zero", "latency_ms", "asc", "", 2), ("slowest", "", "", "", 1), ("slowest", "nonsense", "asc", "blue", 2), ("recent", "did_you_mean", "desc", "", 4))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    logs, out = view(spark, d, "search_logs_v"), None
    # stored once: else every page joins the log anew, and broadcasts what it is joined with
    logs = kept(logs.select(*(c for c in logs.columns if c in SORTS)), "log")
    for i, (name, sort, direction, term, page) in enumerate(PAGES):
        one = log_page(logs, page, 25, view=name, sort=sort, direction=direction, term=term).select(F.lit(i).alias("shown"), "place", "id", "raw_q", "latency_ms")
        out = one if out is None else out.unionByName(one)
    return out


def _export(spark: SparkSession, d: str) -> DataFrame:
    return clustered(view(spark, d, "search_logs_v"), 20_000).export(keep=F.col("ts") >= _ts(BEFORE))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ins: every event is one of its user's, errors are failures."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("who"), (F.col("event_type") == "error").alias("failed"))


def _failed(spark: SparkSession, d: str) -> DataFrame:
    tried = _attempts(spark, d).withColumn("action", F.when(F.col("failed"), "login_failed").otherwise("login"))
    return U.failed_logins(tried, tried.agg(F.max("ts")).scalar(), 2880).select("who", "failures", F.col("last").cast("timestamp_ntz").alias("last"))


QUERIES = {
    "agg_result_health": _log(A.result_health),
    "agg_top_queries": _log(A.top_queries),
    "agg_zero_queries": _log(A.zero_queries),
    "export_grouped": _log(A.grouped_export),
    "agg_cache": _log(A.cache_stats),
    "agg_tier": _log(A.tier_stats),
    "agg_latency": _log(A.latency),
    "agg_dym": _log(A.suggestion_share),
    "agg_unique": _log(A.unique_searches),
    "agg_repeat": _log(A.repeat_rate),
    "agg_requests": _log(A.requests),
    "hist_query_len": _log(A.length_histogram),
    "agg_top_brands": lambda s, d: A.top_names(view(s, d, "search_logs_v"), view(s, d, "products_v"), "brand"),
    "agg_top_tags": lambda s, d: A.top_names(view(s, d, "search_logs_v"), view(s, d, "products_v").withColumn("first", F.split("title", " ")[0]), "first"),
    "trend_volume": _log(A.volume),
    "trend_volume_hourly": _log(lambda logs: A.volume(logs, "hour")),
    "trend_zero_ma": _log(A.zero_trend),
    "trend_latency_p95": _log(A.latency_trend),
    "heatmap": _log(A.heatmap),
    "ins_engagement": _log_events(I.engagement),
    "ins_cold_latency": _log(I.cold_latency),
    "ins_tier_outages": _log(lambda logs: I.tier_outages(logs.withColumn("tier", F.when(F.hour("ts") % 8 < 2, "keyword").otherwise(F.col("tier"))), 1)),
    "ins_capped": _log(I.capped_share),
    "ins_suggestions": _log_events(I.suggestion_pairs),
    "ins_zero_suggestions": _log(I.zero_suggestions),
    "ins_follow_ups": _log(lambda logs: I.follow_ups(logs, FOLLOW_SECONDS).select("id", "q", "next_id")),
    "ins_alias_pairs": _log_events(lambda logs, ev: I.alias_pairs(logs, ev, FOLLOW_SECONDS)),
    "ins_silent": _log_events(lambda logs, ev: I.silent_failures(logs, ev, 5, 40.0)),
    "ins_brand_unmatched": _log(I.brand_unmatched),
    "ins_demand_gap": _log(lambda logs: I.demand_gap(logs, FOLLOW_SECONDS)),
    "ins_trending": _log(lambda logs: I.trending(logs, _ts(AT), _ts(BEFORE))),
    "ins_suspicious": _log(I.suspicious),
    "ins_compare": _log(lambda logs: I.compare(logs, _ts(AT), _ts(BEFORE))),
    "ins_latest_results": lambda s, d: I.latest_results(view(s, d, "search_logs_v"), view(s, d, "products_v")),
    "call_summary": _calls(C.summary),
    "call_hourly_spine": _calls(C.hourly),
    "call_incidents": _calls(lambda calls: C.incidents(calls, 600)),
    "call_incident_baseline": _calls(lambda calls: C.baselines(calls, 600)),
    "call_views": _calls(lambda calls: C.view(calls, "slowest", kind="search").limit(25).select("id", "duration_ms")),
    "export_csv_safe": _calls(lambda calls: C.safe_export(calls).select("id", "kind", "error")),
    "log_duplicates": _log(lambda logs: L.flag_duplicates(logs, 3600).where("is_duplicate").select("id", "session_id", "normalized_q")),
    "log_bursts": _log(lambda logs: L.flag_bursts(logs, 40_000).where("is_burst").select("id", "session_id", "normalized_q")),
    "evt_dedupe": lambda s, d: L.dedupe_events(view(s, d, "search_events_v").withColumn("search_uuid", (F.col("id") % 40).cast("string")), view(s, d, "search_logs_v"), 7200).select("id", "search_uuid", "action"),
    "log_masking": _masked,
    "log_retention": _retained,
    "log_page": _page,
    "log_cache_ttl": _lifetimes,
    "report_all": _log(report),
    "log_pages": _pages,
    "audit_throttled": lambda s, d: U.throttled(_attempts(s, d), 3, 600).select("id", "who", "throttled"),
    "audit_failed": _failed,
    "export_raw": _export,
}

_RAW = {
    "agg_result_health": (f"WITH {SEARCHES} SELECT count(*) AS searches, count(*) FILTER (WHERE result_count = 0) AS zero, {_pct('count(*) FILTER (WHERE result_count = 0)', 'count(*)')} AS zero_pct, round(coalesce(avg(result_count), 0.0), 1) AS avg_results FROM s", "l"),
    "agg_top_queries": (f"WITH {SEARCHES} SELECT q, count(*) AS searches, max(ts) AS last_seen FROM s WHERE q <> '' GROUP BY q ORDER BY searches DESC, last_seen DESC, q LIMIT 20", "l"),
    "agg_zero_queries": (f"WITH {SEARCHES} SELECT q, count(*) AS searches, max(ts) AS last_seen FROM s WHERE q <> '' AND result_count = 0 GROUP BY q ORDER BY searches DESC, last_seen DESC, q LIMIT 20", "l"),
    "export_grouped": ("SELECT coalesce(nullif(normalized_q, ''), raw_q) AS q, count(*) AS searches, max(ts) AS last_seen FROM search_logs_v GROUP BY 1", "l"),
    "agg_cache": (f"WITH {SEARCHES} SELECT count(*) FILTER (WHERE cache_hit) AS hits, count(*) FILTER (WHERE NOT cache_hit) AS misses, {_pct('count(*) FILTER (WHERE cache_hit)', 'count(*)')} AS hit_pct FROM s", "l"),
    "agg_tier": (f"WITH {SEARCHES} SELECT count(*) AS searches, count(*) FILTER (WHERE tier = 'hybrid') AS hybrid, count(*) FILTER (WHERE tier <> 'hybrid') AS keyword_only, {_pct('''count(*) FILTER (WHERE tier = 'hybrid')''', 'count(*)')} AS hybrid_pct FROM s", "l"),
    "agg_latency": (f"WITH {SEARCHES} SELECT count(latency_ms) AS n, round(avg(latency_ms), 1) AS avg_ms, {_disc(0.5, 'latency_ms')} AS p50, {_disc(0.95, 'latency_ms')} AS p95, max(latency_ms) AS max_ms FROM s", "l"),
    "agg_dym": (f"WITH {SEARCHES} SELECT count(*) AS searches, count(*) FILTER (WHERE did_you_mean <> '') AS shown, {_pct('''count(*) FILTER (WHERE did_you_mean <> '')''', 'count(*)')} AS shown_pct FROM s", "l"),
    "agg_unique": (f"WITH {SEARCHES} SELECT count(*) AS unique_searches, count(DISTINCT session_id) AS sessions, round(count(session_id) / count(DISTINCT session_id), 2) AS per_session, {_pct('count(*) FILTER (WHERE result_count = 0)', 'count(*)')} AS zero_pct FROM s", "l"),
    "agg_repeat": (f"WITH {SEARCHES}, g AS (SELECT q, count(*) AS n FROM s GROUP BY q) SELECT cast(sum(n) AS bigint) AS searches, cast(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS bigint) AS repeated, {_pct('sum(CASE WHEN n > 1 THEN n ELSE 0 END)', 'sum(n)')} AS repeat_pct FROM g", "l"),
    "agg_requests": (f"WITH {SEARCHES} SELECT (SELECT count(*) FROM search_logs_v) AS requests, count(*) AS searches, (SELECT count(*) FROM search_logs_v) - count(*) AS filtered FROM s", "l"),
    "hist_query_len": (f"WITH {SEARCHES}, g AS (SELECT least(5, 1 + length(q) - length(replace(q, ' ', ''))) AS words, count(*) AS n FROM s GROUP BY 1) SELECT cast(r.range AS int) AS words, coalesce(n, 0) AS n FROM range(1, 6) r LEFT JOIN g ON g.words = r.range", "l"),
    "agg_top_brands": (f"WITH {SEARCHES}, b AS (SELECT DISTINCT brand AS name FROM products_v), t AS (SELECT q, count(*) AS n, max(ts) AS m FROM s GROUP BY q ORDER BY n DESC, m DESC, q LIMIT 1000) SELECT name, cast(sum(n) AS bigint) AS searches FROM t, b WHERE len(list_filter(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+'), lambda x: NOT list_contains(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}]+'), x))) = 0 GROUP BY name ORDER BY searches DESC, name LIMIT 20", "lp"),
    "agg_top_tags": (f"WITH {SEARCHES}, b AS (SELECT DISTINCT split_part(title, ' ', 1) AS name FROM products_v), t AS (SELECT q, count(*) AS n, max(ts) AS m FROM s GROUP BY q ORDER BY n DESC, m DESC, q LIMIT 1000) SELECT name, cast(sum(n) AS bigint) AS searches FROM t, b WHERE list_contains(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}]+'), name) GROUP BY name ORDER BY searches DESC, name LIMIT 20", "lp"),
    "trend_volume": (f"WITH {SEARCHES} SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS searches FROM s GROUP BY 1 ORDER BY 1 DESC LIMIT 366", "l"),
    "trend_volume_hourly": (f"WITH {SEARCHES} SELECT strftime(ts, '%Y-%m-%d %H:00') AS bucket, count(*) AS searches FROM s GROUP BY 1 ORDER BY 1 DESC LIMIT 744", "l"),
    "trend_zero_ma": (f"WITH {SEARCHES}, g AS (SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS n, count(*) FILTER (WHERE result_count = 0) AS zero FROM s GROUP BY 1) SELECT bucket, n, zero, {_pct('zero', 'n')} AS zero_pct, round(100.0 * sum(zero) OVER m / sum(n) OVER m, 1) AS moving_pct, n < 30 AS low_confidence FROM g WINDOW m AS (ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)", "l"),
    "trend_latency_p95": (f"WITH {SEARCHES} SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS n, {_disc(0.95, 'latency_ms')} AS p95 FROM s GROUP BY 1", "l"),
    "heatmap": (f"WITH {SEARCHES} SELECT cast((dayofweek(ts) + 6) % 7 AS int) AS weekday, cast(hour(ts) AS int) AS hour, count(*) AS searches FROM s GROUP BY 1, 2", "l"),
    "ins_engagement": (f"WITH {SEARCHES}, {V2}, {CLICKS}, j AS (SELECT * FROM v LEFT JOIN c USING (search_uuid) WHERE result_count > 0) SELECT count(*) AS n, count(clicks) AS clicked, {_pct('count(clicks)', 'count(*)')} AS ctr, {_pct('(count(*) - count(clicks))', 'count(*)')} AS no_click_pct, round(coalesce(sum(1.0 / first_position), 0.0)::double / count(*), 4) AS mrr, round(avg(first_position), 2) AS mean_position FROM j", "le"),
    "ins_cold_latency": (f"WITH {V2_ALL} SELECT count(*) AS n, {_disc(0.5, 'latency_ms')} AS p50, {_disc(0.95, 'latency_ms')} AS p95, max(latency_ms) AS max_ms, {_disc(0.95, 'lat_keyword_ms')} AS keyword_p95, {_disc(0.95, 'lat_vector_ms', ' FILTER (WHERE lat_vector_ms IS NOT NULL)')} AS vector_p95 FROM w WHERE NOT cache_hit", "l"),
    "ins_tier_outages": (f"WITH {SEARCHES}, h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (WHERE tier = 'hybrid' AND hour(ts) % 8 >= 2) AS hybrid FROM s WHERE log_version = 2 GROUP BY 1), d AS (SELECT *, epoch(hour) // 3600 - row_number() OVER (ORDER BY hour) AS run FROM h WHERE hybrid = 0 AND n >= 1) SELECT strftime(min(hour), '%Y-%m-%d %H:00') AS \"start\", strftime(max(hour), '%Y-%m-%d %H:00') AS \"end\", count(*) AS hours, cast(sum(n) AS bigint) AS searches FROM d GROUP BY run", "l"),
    "ins_capped": (f"WITH {V2_ALL} SELECT count(*) AS n, count(*) FILTER (WHERE is_capped) AS capped, {_pct('count(*) FILTER (WHERE is_capped)', 'count(*)')} AS capped_pct FROM w", "l"),
    "ins_suggestions": (f"WITH {SEARCHES}, {V2}, k AS (SELECT DISTINCT search_uuid FROM search_events_v WHERE action = 'dym_click') SELECT q, did_you_mean, count(*) AS shown, count(k.search_uuid) AS clicked, {_pct('count(k.search_uuid)', 'count(*)')} AS ctr FROM v LEFT JOIN k ON k.search_uuid = v.search_uuid WHERE did_you_mean <> '' GROUP BY q, did_you_mean ORDER BY shown DESC, q, did_you_mean LIMIT 20", "le"),
    "ins_zero_suggestions": (f"WITH {SEARCHES}, {V2} SELECT count(DISTINCT d.did_you_mean) AS zero_suggestions FROM v d JOIN v z ON z.normalized_q = d.did_you_mean AND z.result_count = 0 WHERE d.did_you_mean <> ''", "l"),
    "ins_follow_ups": (f"WITH {SEARCHES}, {V2}, {FOLLOW} SELECT id, q, next_id FROM f", "l"),
    "ins_alias_pairs": (f"WITH {SEARCHES}, {V2}, {FOLLOW}, k AS (SELECT DISTINCT search_uuid FROM search_events_v WHERE action = 'click') SELECT f.q, b.q AS next_q, count(*) AS pairs, count(k.search_uuid) AS clicks FROM f JOIN v b ON b.id = f.next_id LEFT JOIN k ON k.search_uuid = b.search_uuid GROUP BY f.q, b.q ORDER BY clicks DESC, pairs DESC, f.q, next_q LIMIT 20", "le"),
    "ins_silent": (f"WITH {SEARCHES}, {V2}, {CLICKS}, g AS (SELECT q, count(*) AS n, count(clicks) AS clicked FROM v LEFT JOIN c USING (search_uuid) WHERE result_count > 0 AND q <> '' GROUP BY q) SELECT q, n, clicked, {_pct('clicked', 'n')} AS ctr FROM g WHERE n >= 5 AND {_pct('clicked', 'n')} <= 40.0", "le"),
    "ins_brand_unmatched": (f"WITH {SEARCHES}, {V2} SELECT brand_unmatched AS brand, count(*) AS n, max(q) AS example, max(ts) AS last_seen FROM v WHERE brand_unmatched <> '' GROUP BY 1", "l"),
    "ins_demand_gap": (f"WITH {SEARCHES}, {V2}, {FOLLOW} SELECT q, count(*) AS searches FROM v WHERE result_count = 0 AND q <> '' AND q NOT IN (SELECT q FROM f) GROUP BY q", "l"),
    "ins_trending": (f"WITH {SEARCHES}, a AS (SELECT q, count(*) AS n, max(ts) AS m FROM s WHERE ts >= '{AT}' GROUP BY q ORDER BY n DESC, m DESC, q LIMIT 500), b AS (SELECT q, count(*) AS n, max(ts) AS m FROM s WHERE ts >= '{BEFORE}' AND ts < '{AT}' GROUP BY q ORDER BY n DESC, m DESC, q LIMIT 5000) SELECT a.q, a.n AS searches, coalesce(b.n, 0) AS before, a.n - coalesce(b.n, 0) AS growth FROM a LEFT JOIN b ON a.q = b.q WHERE a.n >= 3 AND a.n > coalesce(b.n, 0)", "l"),
    "ins_suspicious": ("SELECT id, substring(raw_q, 1, 120) AS raw_q, count(*) OVER () AS total FROM search_logs_v WHERE is_suspicious ORDER BY ts DESC, id DESC LIMIT 10", "l"),
    "ins_compare": (f"WITH {SEARCHES}, g AS (SELECT count(*) FILTER (WHERE ts >= '{AT}') AS searches, count(*) FILTER (WHERE ts < '{AT}') AS searches_before, count(*) FILTER (WHERE ts >= '{AT}' AND result_count = 0) AS zero, count(*) FILTER (WHERE ts < '{AT}' AND result_count = 0) AS zero_before FROM s WHERE ts >= '{BEFORE}') SELECT *, searches - searches_before AS change, CASE WHEN searches_before <> 0 THEN round(100.0 * (searches - searches_before) / searches_before, 1) END AS change_pct FROM g", "l"),
    "ins_latest_results": (f"WITH {SEARCHES}, r AS (SELECT q, product_id, row_number() OVER (PARTITION BY q ORDER BY ts DESC, id DESC) AS n FROM s) SELECT q, r.product_id, p.title FROM r LEFT JOIN products_v p USING (product_id) WHERE n = 1", "lp"),
    "call_summary": ("SELECT kind, count(*) FILTER (WHERE outcome <> 'skipped') AS calls, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in C.OUTCOMES) + f", round(100.0 * count(*) FILTER (WHERE outcome = 'ok') / nullif(count(*) FILTER (WHERE outcome <> 'skipped'), 0), 1) AS ok_pct, {_disc(0.5, 'duration_ms')} AS p50, {_disc(0.95, 'duration_ms')} AS p95, max(duration_ms) AS max_ms, count(*) FILTER (WHERE outcome = 'ok' AND duration_ms > timeout_ms * 0.8) AS near, round(100.0 * count(*) FILTER (WHERE outcome = 'ok' AND duration_ms > timeout_ms * 0.8) / nullif(count(*) FILTER (WHERE outcome <> 'skipped'), 0), 1) AS near_pct FROM calls_v GROUP BY kind", "c"),
    "call_hourly_spine": ("WITH g AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS calls, count(*) FILTER (WHERE outcome = 'timeout') AS failed FROM calls_v GROUP BY 1), r AS (SELECT unnest(generate_series((SELECT min(hour) FROM g), (SELECT max(hour) FROM g), INTERVAL 1 HOUR)) AS hour) SELECT strftime(r.hour, '%Y-%m-%d %H:00') AS hour, coalesce(calls, 0) AS calls, coalesce(failed, 0) AS failed FROM r LEFT JOIN g ON g.hour = r.hour", "c"),
    "call_incidents": ("WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, id) <= INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS fresh FROM calls_v WHERE outcome = 'timeout'), g AS (SELECT *, sum(fresh) OVER (ORDER BY ts, id) AS run FROM f), k AS (SELECT run, kind, min(id) AS first FROM g GROUP BY run, kind) SELECT min(ts) AS \"start\", max(ts) AS \"end\", count(*) AS n, (SELECT string_agg(kind, ',' ORDER BY first) FROM k WHERE k.run = g.run) AS kinds FROM g GROUP BY run", "c"),
    "call_incident_baseline": ("WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, id) <= INTERVAL 600 SECONDS THEN 0 ELSE 1 END AS fresh FROM calls_v WHERE outcome = 'timeout'), g AS (SELECT *, sum(fresh) OVER (ORDER BY ts, id) AS run FROM f), i AS (SELECT min(ts) AS a, max(ts) AS b, count(*) AS n FROM g GROUP BY run ORDER BY a DESC LIMIT 50), o AS (SELECT * FROM calls_v WHERE kind = 'search' AND outcome = 'ok') SELECT a AS \"start\", b AS \"end\", n, (SELECT cast(round(median(duration_ms)) AS bigint) FROM (SELECT duration_ms FROM o WHERE o.ts < a ORDER BY ts DESC, id LIMIT 10)) AS before_ms, (SELECT cast(round(median(duration_ms)) AS bigint) FROM (SELECT duration_ms FROM o WHERE o.ts > b ORDER BY ts, id LIMIT 10)) AS after_ms FROM i", "c"),
    "call_views": ("SELECT id, duration_ms FROM calls_v WHERE kind = 'search' ORDER BY duration_ms DESC, id DESC LIMIT 25", "c"),
    "export_csv_safe": ("SELECT id, kind, CASE WHEN error[1] IN ('=', '+', '-', '@') THEN '''' || error ELSE error END AS error FROM calls_v ORDER BY id DESC LIMIT 50000", "c"),
    "log_duplicates": ("SELECT id, session_id, normalized_q FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY session_id, normalized_q, page ORDER BY ts, id) <= INTERVAL 3600 SECONDS AS d FROM search_logs_v) WHERE d AND session_id IS NOT NULL", "l"),
    "log_bursts": ("SELECT id, session_id, normalized_q FROM search_logs_v l WHERE page = 1 AND (SELECT count(*) FROM search_logs_v m WHERE m.page = 1 AND m.normalized_q = l.normalized_q AND m.session_id IS NOT DISTINCT FROM l.session_id AND m.ts >= l.ts - INTERVAL 40000 SECONDS AND (m.ts < l.ts OR (m.ts = l.ts AND m.id < l.id))) >= 3", "l"),
    "evt_dedupe": ("SELECT id, search_uuid, action FROM (SELECT id, cast(id % 40 AS string) AS search_uuid, action, ts - lag(ts) OVER (PARTITION BY id % 40, product_id, action ORDER BY ts, id) AS gap FROM search_events_v WHERE cast(id % 40 AS string) IN (SELECT search_uuid FROM search_logs_v)) WHERE gap IS NULL OR gap > INTERVAL 7200 SECONDS", "le"),
    "log_masking": ("SELECT id, regexp_replace(raw_q || ' ' || cast(id * 100003 AS string), '[0-9]{7,}', '#', 'g') AS raw_q FROM search_logs_v", "l"),
    "log_retention": ("SELECT kind, count(*) AS n FROM calls_v WHERE ts >= (SELECT max(ts) FROM calls_v) - INTERVAL 10 DAYS GROUP BY kind", "c"),
    "log_cache_ttl": ("WITH k AS (SELECT coalesce(nullif(normalized_q, ''), raw_q) AS key, result_count = 0 AS empty, cast(floor(epoch(ts)) AS bigint) AS t FROM search_logs_v), c AS (SELECT *, count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS n FROM k) SELECT cast(CASE WHEN empty THEN 300 WHEN n >= 30 THEN 604800 ELSE 86400 END AS int) AS ttl, count(*) AS n, max(c.n) AS most FROM c GROUP BY 1", "l"),
    "log_page": ("SELECT id, raw_q, latency_ms FROM search_logs_v WHERE id > (SELECT max(id) FROM search_logs_v) - 5000 AND (contains(raw_q, 'gear') OR contains(normalized_q, 'gear')) AND result_count = 0 ORDER BY id DESC LIMIT 20 OFFSET 20", "l"),
}

_Z, _H, _Y, _D = ("count(*) FILTER (WHERE result_count = 0)", "count(*) FILTER (WHERE cache_hit)", "count(*) FILTER (WHERE tier = 'hybrid')", "count(*) FILTER (WHERE did_you_mean <> '')")


def _cells(rows: str, name: str, **cells: str) -> str:
    """A report of several figures over the same rows."""
    return " UNION ALL ".join(f"SELECT '{name}' AS report, '{k}' AS key, cast({c} AS double) AS value FROM {rows}" for k, c in cells.items())


_DAY, _HOUR = "strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-%m-%d %H:00')"
_RAW["report_all"] = (f"WITH {SEARCHES}, {V2}, {V2_ALL}, cold AS (SELECT * FROM w WHERE NOT cache_hit), g AS (SELECT q, count(*) AS n FROM s WHERE q <> '' GROUP BY q), dz AS (SELECT {_DAY} AS key, count(*) AS n, {_Z} AS zero FROM s GROUP BY 1) " + " UNION ALL ".join([
    _cells("s", "summary", searches="count(*)", zero=_Z, zero_pct=_pct(_Z, "count(*)"), avg_results="round(coalesce(avg(result_count), 0.0), 1)"),
    _cells("s", "cache", hits=_H, misses=f"count(*) - {_H}", hit_pct=_pct(_H, "count(*)")), _cells("s", "tier", hybrid=_Y, keyword_only=f"count(*) - {_Y}", hybrid_pct=_pct(_Y, "count(*)")),
    _cells("s", "did_you_mean", shown=_D, shown_pct=_pct(_D, "count(*)")), _cells("s", "unique", sessions="count(DISTINCT session_id)", per_session="round(count(session_id) / count(DISTINCT session_id), 2)"),
    _cells("g", "repeat_queries", searches="sum(n)", repeated="sum(CASE WHEN n > 1 THEN n ELSE 0 END)", repeat_pct=_pct("sum(CASE WHEN n > 1 THEN n ELSE 0 END)", "sum(n)")),
    _cells("s", "requests", requests="max((SELECT count(*) FROM search_logs_v))", searches="count(*)", filtered="(SELECT count(*) FROM search_logs_v) - count(*)"),
    _cells("s", "latency", n="count(latency_ms)", avg_ms="round(avg(latency_ms), 1)", p50=_disc(0.5, "latency_ms"), p95=_disc(0.95, "latency_ms"), max_ms="max(latency_ms)"),
    _cells("cold", "latency_cold", n="count(*)", p50=_disc(0.5, "latency_ms"), p95=_disc(0.95, "latency_ms"), max_ms="max(latency_ms)"),
    _cells("w", "capped_share", n="count(*)", capped="count(*) FILTER (WHERE is_capped)", capped_pct=_pct("count(*) FILTER (WHERE is_capped)", "count(*)")),
    f"(SELECT 'volume', {_DAY} AS key, count(*)::double FROM s GROUP BY ALL ORDER BY key DESC LIMIT 366)", f"(SELECT 'volume_hourly', {_HOUR} AS key, count(*)::double FROM s GROUP BY ALL ORDER BY key DESC LIMIT 744)",
    f"SELECT 'zero_rate_trend', key, {_pct('zero', 'n')} FROM dz", "SELECT 'zero_rate_moving', key, round(100.0 * sum(zero) OVER m / sum(n) OVER m, 1)::double FROM dz WINDOW m AS (ORDER BY key ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    f"SELECT 'latency_trend', {_DAY}, {_disc(0.95, 'latency_ms')} FROM s GROUP BY 2", "SELECT 'hourly_heatmap', (dayofweek(ts) + 6) % 7 || ' ' || hour(ts), count(*)::double FROM s GROUP BY 2",
    "SELECT 'query_length', r.range::varchar, coalesce(n, 0)::double FROM range(1, 6) r LEFT JOIN (SELECT least(5, 1 + length(q) - length(replace(q, ' ', ''))) AS words, count(*) AS n FROM s GROUP BY 1) x ON x.words = r.range",
    "(SELECT 'top_queries', q, count(*)::double FROM s WHERE q <> '' GROUP BY q ORDER BY count(*) DESC, max(ts) DESC, q LIMIT 20)", "(SELECT 'zero_result_queries', q, count(*)::double FROM s WHERE q <> '' AND result_count = 0 GROUP BY q ORDER BY count(*) DESC, max(ts) DESC, q LIMIT 20)",
    "SELECT 'brand_unmatched', brand_unmatched, count(*)::double FROM v WHERE brand_unmatched <> '' GROUP BY 2",
]), "l")
_ORDERS = ("id DESC", "id DESC", "raw_q ASC NULLS FIRST, id ASC", "id DESC", "latency_ms ASC NULLS FIRST, id ASC", "latency_ms DESC NULLS LAST, id DESC", "latency_ms DESC NULLS LAST, id DESC", "did_you_mean DESC NULLS LAST, id DESC")
_RAW["log_pages"] = (" UNION ALL ".join(
    f"SELECT {i} AS shown, place, id, raw_q, latency_ms FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM search_logs_v WHERE {'result_count = 0' if p[0] == 'zero' else 'true'} AND (contains(lower(raw_q), '{p[3].lower()}') OR contains(lower(normalized_q), '{p[3].lower()}'))) WHERE place > {25 * (p[4] - 1)} AND place <= {25 * p[4]}"
    for i, (p, order) in enumerate(zip(PAGES, _ORDERS))
), "l")
_RAW["export_raw"] = (f"SELECT place // 2000 AS page, place, id, ts, raw_q, normalized_q, result_count, latency_ms, did_you_mean, tier, cache_hit FROM (SELECT *, row_number() OVER (ORDER BY id DESC) - 1 AS place FROM search_logs_v WHERE ts >= '{BEFORE}')", "l")
_ATTEMPTS = "t AS (SELECT event_id AS id, ts, 'u' || user_id % 50 AS who, event_type = 'error' AS failed FROM events)"
_RAW["audit_throttled"] = (f"WITH {_ATTEMPTS} SELECT id, who, count(*) FILTER (WHERE failed) OVER (PARTITION BY who ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND 1 PRECEDING) >= 3 AS throttled FROM t", "l")
_RAW["audit_failed"] = (f"WITH {_ATTEMPTS} SELECT who, count(*) AS failures, max(ts) AS last FROM t WHERE failed AND ts > (SELECT max(ts) FROM t) - INTERVAL 2880 MINUTES GROUP BY who", "l")
_VIEWS = {"l": "search_logs_v", "e": "search_events_v", "c": "calls_v", "p": "products_v"}
SQL = {name: with_views(sql, *(_VIEWS[v] for v in views)) for name, (sql, views) in _RAW.items()}
