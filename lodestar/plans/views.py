"""The engine's tables over the driver's tables, as SQL that Spark and DuckDB both run.

Catalog, search log, click events, service calls, queries and vectors are derived row by row, so every
operator can run on the same deterministic input in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import KEYS
from ..operators.lexicon import there
from ..operators.retrieve import Index

RATIO = 0.5  # the driver's catalog has few words, each in many products

VIEWS = {
    "products_v": """
        SELECT p.p_partkey AS product_id, p.p_name || ' ' || p.p_brand AS title, coalesce(d.text, '') AS description,
               p.p_brand AS brand, p.p_type AS category, p.p_type || ' ' || p.p_name AS tags,
               'size: ' || cast(p.p_size AS string) || ' | kind: ' || p.p_type AS specs, 'SKU-' || cast(p.p_partkey AS string) AS sku,
               cast(p.p_retailprice AS decimal(15, 4)) AS price, cast(p.p_size % 4 AS int) AS stock, coalesce(l.n, 0) AS popularity
        FROM {part} p LEFT JOIN {documents} d ON d.doc_id = p.p_partkey
        LEFT JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey""",
    "search_logs_v": """
        SELECT e.event_id AS id, e.ts, CASE WHEN e.event_id % 7 = 0 THEN upper(p.p_name) ELSE p.p_name END AS raw_q,
               CASE WHEN e.event_id % 50 = 0 THEN '' WHEN e.event_id % 9 = 4 THEN p.p_name || ' ' || lower(p.p_brand) ELSE p.p_name END AS normalized_q,
               CASE WHEN e.event_type = 'error' THEN 0 ELSE cast(floor(e.value) AS bigint) END AS result_count,
               cast(floor(e.value * 10) AS bigint) AS latency_ms, CASE WHEN e.event_id % 10 < 7 THEN 'hybrid' ELSE 'keyword' END AS tier,
               e.event_id % 4 = 0 AS cache_hit, cast(CASE WHEN e.event_id % 20 = 0 THEN 1 ELSE 2 END AS int) AS log_version,
               cast(e.event_id AS string) AS search_uuid,
               CASE WHEN e.user_id % 10 = 0 THEN NULL ELSE 's' || cast(e.user_id % 15 AS string) END AS session_id,
               CASE WHEN e.event_id % 8 = 3 THEN 'filter' ELSE 'page' END AS source,
               cast(CASE WHEN e.event_id % 12 = 5 THEN 2 ELSE 1 END AS int) AS page, e.event_id % 97 = 0 AS is_suspicious,
               CASE WHEN e.event_type = 'error' AND e.k % 3 = 0 THEN p.p_brand END AS brand_unmatched,
               CASE WHEN e.event_type = 'error' AND e.k % 5 = 0 THEN p.p_type WHEN e.event_type = 'error' AND e.k % 7 = 0 THEN 'hot gear' END AS did_you_mean,
               floor(e.value) >= 300 AS is_capped, cast(floor(e.value * 4) AS bigint) AS lat_keyword_ms,
               CASE WHEN e.event_id % 10 < 7 THEN cast(floor(e.value * 5) AS bigint) END AS lat_vector_ms, e.k AS product_id
        FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM {events}) e JOIN {part} p ON p.p_partkey = e.k""",
    "search_events_v": """
        SELECT event_id AS id, ts, cast(event_id AS string) AS search_uuid, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS product_id,
               cast(1 + cast(regexp_extract(props, '([0-9]+)', 1) AS int) % 10 AS int) AS position,
               CASE WHEN event_type = 'click' THEN 'click' ELSE 'dym_click' END AS action
        FROM {events} WHERE event_type IN ('click', 'purchase')""",
    "calls_v": """
        SELECT event_id AS id, ts, CASE event_id % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'probe' ELSE 'reload' END AS kind,
               CASE event_type WHEN 'error' THEN 'timeout' WHEN 'signup' THEN 'skipped' ELSE 'ok' END AS outcome,
               cast(floor(value * 10) AS bigint) AS duration_ms, cast(3000 AS bigint) AS timeout_ms,
               CASE WHEN event_id % 5 = 0 THEN '=cmd' WHEN event_type = 'error' THEN 'timed out' END AS error
        FROM {events}""",
    "typos_v": """
        SELECT k * 4 + kind AS query_id, CASE kind WHEN 0 THEN typo WHEN 1 THEN translate(name, '{latin}', '{persian}') WHEN 2 THEN translate(typo, '{latin}', '{persian}') ELSE replace(name, ' ', '') END AS raw_q
        FROM (SELECT name, k, kind, CASE WHEN length(name) > 5 THEN substring(name, 1, length(name) - 3) || substring(name, length(name) - 1, 1) || substring(name, length(name) - 2, 1) || substring(name, length(name), 1) ELSE name END AS typo
            FROM (SELECT p_name AS name, min(p_partkey) AS k FROM {part} GROUP BY p_name UNION ALL SELECT DISTINCT 'azure widget ' || p_size, -1 - p_size FROM {part}) n CROSS JOIN (SELECT 0 AS kind UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) kinds) t
        """,
    "queries_v": """
        SELECT row_number() OVER (ORDER BY raw_q) AS query_id, raw_q FROM (
            SELECT DISTINCT p_name AS raw_q FROM {part} UNION SELECT DISTINCT p_type FROM {part}
            UNION SELECT DISTINCT p_type || ' ' || p_name FROM {part} WHERE p_partkey % 50 = 0
            UNION SELECT DISTINCT p_name || ' ' || p_brand FROM {part} WHERE p_partkey % 50 = 0
            UNION SELECT DISTINCT 'sku-' || cast(p_partkey AS string) FROM {part} WHERE p_partkey % 50 = 0
            UNION SELECT 'brand' UNION SELECT 'gizm' UNION SELECT 'wid small' UNION SELECT 'smallgizmo' UNION SELECT 'brand7' UNION SELECT 'no such thing' UNION SELECT '11')
        """,
}

#: Letter keys of the Latin layout, and what they write on the Persian one.
for side, letters in (("latin", (k for k in KEYS if k.islower())), ("persian", (v for k, v in KEYS.items() if k.islower()))):
    VIEWS["typos_v"] = VIEWS["typos_v"].replace("{%s}" % side, "".join(letters))
TABLES = "part documents lineitem events embeddings".split()
_USES = {name: [t for t in TABLES if "{%s}" % t in text] for name, text in VIEWS.items()}


_INDEXES: dict[tuple, Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The index of the catalog, made once for a session and folder, and anew if its files are gone."""
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf_dir)
    index = _INDEXES.get(key)
    if index is None or not there(index.postings):
        index = _INDEXES[key] = Index(view(spark, sf_dir, "products_v"), RATIO)
    return index


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _USES[name]})


def with_views(sql: str, *names: str) -> str:
    """The DuckDB form of a query over these views."""
    text = ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {text}, {body[15:]}"
    return f"WITH {text}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {text} {body}"
