"""Queries over the catalog: text functions, lexicon, keyword retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import lexicon as X
from ..operators.catalog import server_rows
from ..operators.retrieve import Index
from ..operators.search import keyword_search
from .views import RATIO, index_of, view, with_views

W = r"[\p{L}\p{N}]+"
ROMAN = "(viii|vii|iii|iv|vi|ix|ii)"


def sql_canonical(x: str) -> str:
    out = rf"lower(regexp_replace({x}, '\s+', ' ', 'g'))"
    for _ in range(2):  # matches of the first pass can't share a character
        out = rf"regexp_replace({out}, '([0-9a-z])[-_./]+([0-9a-z])', '\1\2', 'g')"
    return rf"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def sql_normalize(x: str) -> str:
    a = f"string_split({sql_canonical(x)}, ' ')"
    digit = "CASE regexp_extract(z[2], '" + ROMAN + "', 1) " + " ".join(f"WHEN '{r}' THEN '{d}'" for r, d in T.ROMAN.items()) + " END"
    roman = rf"regexp_matches(z[1], '\p{{L}}') AND regexp_matches(z[2], '^[^\p{{L}}\p{{N}}]*{ROMAN}[^\p{{L}}\p{{N}}]*$')"
    return f"array_to_string(list_transform(list_zip(list_prepend('', {a}), {a}), lambda z: CASE WHEN {roman} THEN regexp_replace(z[2], '{ROMAN}', {digit}) ELSE z[2] END), ' ')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({sql_normalize(x)}, '{W}')"


_PROFILE = f"""
qt0 AS (SELECT query_id, {sql_tokens('raw_q')} AS toks FROM queries_v),
qt AS (SELECT query_id, toks, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM qt0),
pn AS (SELECT *, {sql_normalize('title')} AS ntitle FROM products_v),
n AS (SELECT count(*) AS n FROM pn),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(list_concat({sql_tokens('title')}, {sql_tokens('tags')}))) AS token FROM pn) GROUP BY token HAVING count(*) >= 2),
w0 AS (SELECT query_id, pos, token, NOT regexp_matches(token, '^[0-9]+$') AND coalesce(df, 0) / n > {RATIO} AS generic, coalesce(df, 0) AS d, n FROM qt LEFT JOIN df USING (token), n),
w1 AS (SELECT *, CASE WHEN generic THEN 0.1::double WHEN n < 3 THEN 1.0::double ELSE least(1.0, greatest(0.2, ln(n / (1 + d)) / ln(n))) END AS w FROM w0),
w2 AS (SELECT *, sum(w) OVER q AS tot, max(w) OVER q AS top, count(*) OVER q AS cnt FROM w1 WINDOW q AS (PARTITION BY query_id)),
w3 AS (SELECT *, min(CASE WHEN w = top THEN pos END) OVER (PARTITION BY query_id) AS heavy FROM w2),
w4 AS (SELECT query_id, pos, token, generic, CASE WHEN cnt > 1 AND pos = heavy THEN least(w, tot - w) ELSE w END AS w FROM w3),
prof AS (SELECT *, sum(w) OVER (PARTITION BY query_id) AS total, count(*) FILTER (WHERE NOT generic) OVER (PARTITION BY query_id) AS needed FROM w4)"""

_POSTINGS = "post AS (" + " UNION ALL ".join(f"SELECT product_id, {lv} AS level, unnest(list_distinct({sql_tokens(f)})) AS word FROM pn" for f, lv in (("title", 1), ("tags", 2), ("brand", 3), ("category", 4), ("specs", 5), ("description", 0))) + ")"


def _hits(where_level: str = "true", whole: int = 0, only: str = "true", x: str = "") -> str:
    """CTEs m, g, h, k (with a suffix ``x``): scored hits; ``only``: a condition on query_id."""
    return f"""
voc{x} AS (SELECT DISTINCT word FROM post),
mean{x} AS (SELECT token, word FROM (SELECT DISTINCT token FROM prof WHERE {only}) JOIN voc{x} ON left(word, 3) = left(token, 3) AND CASE WHEN length(token) < 3 OR length(token) <= {whole} THEN word = token ELSE starts_with(word, token) END),
m{x} AS (SELECT query_id, pos, generic, w, total, needed, product_id, coalesce(min(CASE WHEN level > 0 THEN level END), 0) AS lv
      FROM prof JOIN mean{x} USING (token) JOIN post USING (word) WHERE {only} AND {where_level} AND (length(token) >= 3 OR level IN (1, 2)) GROUP BY ALL),
g{x} AS (SELECT query_id, product_id, total, needed, count(*) FILTER (WHERE NOT generic) AS held, count(*) FILTER (WHERE NOT generic AND lv = 1) AS title_hits, count(*) FILTER (WHERE NOT generic AND lv > 1) AS field_hits, count(*) FILTER (WHERE NOT generic AND lv IN (1, 2)) AS name_hits,
             sum(w * CASE lv WHEN 1 THEN 10 WHEN 2 THEN 8 WHEN 3 THEN 7 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 0 END) AS credit, sum(CASE WHEN NOT generic AND lv = 0 THEN w ELSE 0 END) AS described, sum(CASE WHEN NOT generic OR lv > 0 THEN w ELSE 0 END) AS held_weight
      FROM m{x} GROUP BY ALL HAVING count(*) FILTER (WHERE NOT generic) > 0),
tt{x} AS (SELECT product_id, popularity, ' ' || array_to_string(regexp_extract_all(ntitle, '{W}'), ' ') AS words FROM pn),
h{x} AS (SELECT g{x}.*, tt{x}.popularity, needed > 1 AND contains(words, ' ' || array_to_string(toks, ' ')) AS phrase FROM g{x} JOIN tt{x} USING (product_id) JOIN qt0 USING (query_id)),
k{x} AS (SELECT *, round((credit + described) / total + CASE WHEN phrase THEN 5.0 ELSE 0.0 END, 6) AS score, round(least(1.0, held_weight / total), 6) AS coverage FROM h{x})"""


_ORDER = "held DESC, (title_hits > 0) DESC, (title_hits = 0 AND field_hits > 0) DESC, score DESC, popularity DESC, product_id"


def _top(where: str, score: str = "score", limit: int = 20) -> str:
    inner = f"SELECT * REPLACE ({score} AS score) FROM k WHERE {where}"
    return f"SELECT query_id, product_id, held, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM ({inner})) WHERE rank <= {limit}"


def _retrieval(tail: str, where_level: str = "true", whole: int = 0) -> str:
    return with_views(f"WITH {_PROFILE}, {_POSTINGS}, {_hits(where_level, whole)} {tail}", "products_v", "queries_v")


def _index(spark: SparkSession, d: str) -> tuple[Index, DataFrame]:
    return index_of(spark, d), view(spark, d, "queries_v")


def _kw(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        index, queries = _index(spark, d)
        return getattr(index, name)(queries).select("query_id", "product_id", "held", "score", "rank")

    return run


def kw_sku(spark: SparkSession, d: str) -> DataFrame:
    index, queries = _index(spark, d)
    return index.sku(queries)


def intents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Brand", ["ECONOMY"], ["hot gear"]), ("hot gear", ["PROMO"], []), ("red", [], ["red"])], "term string, categories array<string>, tags array<string>")


def search_keyword(spark: SparkSession, d: str) -> DataFrame:
    index, queries = _index(spark, d)
    return keyword_search(index, queries, intents(spark))


def kw_collapsed(spark: SparkSession, d: str) -> DataFrame:
    index, queries = _index(spark, d)
    return index.collapsed(queries).drop("name_all")


def _docs(columns):
    """``columns``: a function, since columns can only be made once a session runs."""
    return lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", *columns())


def _products(f):
    return lambda spark, d: f(view(spark, d, "products_v"))


def txt_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Transpositions and kept digits of catalog names."""
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", F.explode(T.transpositions(F.col("p_name"))).alias("swapped"))
    return rows.withColumn("kept", T.keeps_digits(F.concat("p_name", F.lit("12")), F.concat("swapped", (F.col("p_partkey") % 40).cast("string"), F.lit("1"))))


def txt_rest(spark: SparkSession, d: str) -> DataFrame:
    """The words of each text that aren't among its first three."""
    words = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.tokenize(T.normalize("text")).alias("t"))
    return words.select("doc_id", F.md5(F.array_join(T.rest_of(F.col("t"), F.array(*(F.coalesce(F.get("t", F.lit(i)), F.lit("")) for i in range(3)))), " ")).alias("out"))


def math_idf(products: DataFrame) -> DataFrame:
    out = X.token_weights(products)
    return out.withColumn("weight", F.round("weight", 9))


def date_buckets(spark: SparkSession, d: str) -> DataFrame:
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select("event_id", S.bucket(F.col("ts"), "day").alias("day"), S.bucket(F.col("ts"), "hour").alias("hour"), F.weekday("ts").alias("weekday"))


def date_jalali(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.to_date("o_orderdate").alias("day")).distinct()
    return orders.select(F.date_format("day", "yyyy-MM-dd").alias("day"), S.jalali(F.col("day")).alias("j")).select("day", "j.year", "j.month", F.col("j.day").alias("jday"))


def etl_server_rows(products: DataFrame) -> DataFrame:
    return server_rows(products.withColumnRenamed("specs", "attributes"), 120)


def etl_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each key wins."""
    from ..sources.catalog import last_per_key

    items = spark.read.parquet(f"{d}/lineitem.parquet")
    return last_per_key(items, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


def agg_listagg(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    return X.joined_names(part, "p_brand", "p_name")


QUERIES = {
    "kw_strict": _kw("strict"),
    "search_keyword": search_keyword,
    "kw_any_terms": _kw("any_terms"),
    "kw_soft_and": _kw("soft_and"),
    "kw_structured": _kw("structured"),
    "kw_title_only": _kw("title_only"),
    "kw_sku": kw_sku,
    "kw_collapsed": kw_collapsed,
    "txt_normalize": _docs(lambda: [T.normalize("text").alias("out")]),
    "txt_tokenize": _docs(lambda: [F.size(T.tokenize(T.normalize("text"))).alias("n"), F.md5(F.array_join(T.tokenize(T.normalize("text")), "|")).alias("tokens")]),
    "txt_collapse": _docs(lambda: [F.md5(T.collapse("text")).alias("out")]),
    "txt_cap": _docs(lambda: [T.cap("text")["text"].alias("text"), T.cap("text")["was_cut"].alias("was_cut")]),
    "txt_mask": _docs(lambda: [T.mask_digits("text").alias("out")]),
    "txt_suspicious": _docs(lambda: [T.is_suspicious("text").alias("out")]),
    "txt_length_bucket": _docs(lambda: [T.length_bucket("text").alias("out")]),
    "txt_spelling": txt_spelling,
    "txt_like": _docs(lambda: [F.md5(T.like_escape("text")).alias("out")]),
    "txt_rest": txt_rest,
    "math_idf": _products(math_idf),
    "date_buckets": date_buckets,
    "date_jalali": date_jalali,
    "lex_token_df": _products(X.token_df),
    "lex_spell_dict": _products(X.spell_dictionary),
    "lex_facet_terms": _products(X.facet_terms),
    "lex_brand_ambiguous": lambda s, d: X.brands(view(s, d, "products_v").withColumn("brand", F.split("title", " ")[1])),
    "lex_titles_with": _products(lambda p: X.titles_with(p, ("old", "hot gear"))),
    "lex_synonym_groups": lambda s, d: X.synonym_groups(s.read.parquet(f"{d}/part.parquet").withColumn("model", F.col("p_size") * 100 + F.col("p_partkey") % 53).withColumn("kind", F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), (F.col("p_partkey") % 7).cast("string"))).withColumn("model", F.col("model").cast("string")), "model", "kind"),
    "agg_listagg": agg_listagg,
    "etl_server_rows": _products(etl_server_rows),
    "etl_upsert": etl_upsert,
}

_DF = f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(list_concat({sql_tokens('title')}, {sql_tokens('tags')}))) AS token FROM products_v) GROUP BY token HAVING count(*) >= 2"
_PHRASED = f"' ' || array_to_string(list_concat({sql_tokens('title')}, {sql_tokens('tags')}), ' ') || ' '"
_NOTWORD = r"[^\p{L}\p{N}]+"
_RAW = {
    "txt_normalize": f"SELECT doc_id, {sql_normalize('text')} AS out FROM documents",
    "txt_tokenize": f"SELECT doc_id, len({sql_tokens('text')}) AS n, md5(array_to_string({sql_tokens('text')}, '|')) AS tokens FROM documents",
    "txt_collapse": f"SELECT doc_id, md5(regexp_replace({sql_normalize('text')}, '{_NOTWORD}', '', 'g')) AS out FROM documents",
    "txt_cap": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, trim(substring(array_to_string(w[1:8], ' '), 1, 100)) AS text, array_to_string(w, ' ') AS whole FROM w) SELECT doc_id, text, text <> whole AS was_cut FROM c",
    "txt_mask": r"WITH m AS (SELECT doc_id, regexp_replace(text, '\p{Nd}{7,}', '#', 'g') AS m FROM documents) SELECT doc_id, CASE WHEN length(m) > 80 THEN '[long query]' ELSE m END AS out FROM m",
    "txt_suspicious": r"SELECT doc_id, regexp_matches(text, '(?i)extractvalue|concat\s*\(\s*0x|union\s+(?:all\s+)?select|sleep\s*\(') OR (contains(text, '--') AND regexp_matches(text, '[''" + '"' + r"`]')) AS out FROM documents",
    "txt_length_bucket": "SELECT doc_id, cast(least(5, 1 + length(text) - length(replace(text, ' ', ''))) AS int) AS out FROM documents",
    "txt_like": r"SELECT doc_id, md5(replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_')) AS out FROM documents",
    "txt_rest": f"WITH t AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents) SELECT doc_id, md5(array_to_string(list_filter(t, lambda x: NOT list_contains(t[1:3], x)), ' ')) AS out FROM t",
    "txt_spelling": "SELECT p_partkey, p_name, s.swapped, contains(cast(p_partkey % 40 AS string), '2') AS kept FROM part, LATERAL (SELECT substring(p_name, 1, i - 1) || substring(p_name, i + 1, 1) || substring(p_name, i, 1) || substring(p_name, i + 2) AS swapped FROM unnest(generate_series(1, cast(length(p_name) - 1 AS bigint))) AS u(i)) s",
    "date_buckets": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:00') AS hour, cast((dayofweek(ts) + 6) % 7 AS int) AS weekday FROM events",
    "date_jalali": """WITH d AS (SELECT DISTINCT cast(o_orderdate AS date) AS d FROM orders), e AS (SELECT d, date_diff('day', DATE '1600-03-20', d) AS n FROM d),
        c AS (SELECT d, 979 + 33 * (n // 12053) + 4 * ((n % 12053) // 1461) AS y, (n % 12053) % 1461 AS r FROM e),
        g AS (SELECT d, CASE WHEN r >= 366 THEN y + (r - 1) // 365 ELSE y END AS y, CASE WHEN r >= 366 THEN (r - 1) % 365 ELSE r END AS r FROM c)
        SELECT strftime(d, '%Y-%m-%d') AS day, cast(y AS int) AS year, cast(CASE WHEN r < 186 THEN 1 + r // 31 ELSE 7 + (r - 186) // 30 END AS int) AS month, cast(CASE WHEN r < 186 THEN 1 + r % 31 ELSE 1 + (r - 186) % 30 END AS int) AS jday FROM g""",
    "agg_listagg": "SELECT p_brand, substring(string_agg(DISTINCT p_name, ', ' ORDER BY p_name), 1, 255) AS names FROM part GROUP BY p_brand",
    "etl_upsert": "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1",
    "lex_synonym_groups": """WITH RECURSIVE r AS (SELECT DISTINCT cast(p_size * 100 + p_partkey % 53 AS string) AS k, p_brand || '/' || p_type || '/' || cast(p_partkey % 7 AS string) AS m FROM part),
        e AS (SELECT DISTINCT a.m AS x, b.m AS y FROM r a JOIN r b ON a.k = b.k AND a.m <> b.m),
        c AS (SELECT x AS node, x AS label FROM e UNION SELECT e.y, c.label FROM c JOIN e ON e.x = c.node WHERE c.label < e.y),
        l AS (SELECT node, min(label) AS label FROM c GROUP BY node), g AS (SELECT label, node FROM l)
        SELECT label, string_agg(node, ',' ORDER BY node) AS members FROM g GROUP BY label HAVING count(*) > 1""",
}
_SKU = f"sa AS (SELECT query_id, regexp_replace({sql_canonical('raw_q')}, '{_NOTWORD}', '', 'g') AS code FROM queries_v), sb AS (SELECT product_id, popularity, regexp_replace({sql_canonical('sku')}, '{_NOTWORD}', '', 'g') AS sku FROM products_v), sk AS (SELECT query_id, product_id, sku = code AS exact, row_number() OVER (PARTITION BY query_id ORDER BY sku = code DESC, length(sku), popularity DESC, product_id) AS rank FROM sa JOIN sb ON left(sku, 4) = left(code, 4) AND (sku = code OR (length(code) >= 4 AND regexp_matches(code, '[0-9]') AND starts_with(sku, code))) WHERE code <> '' QUALIFY rank <= 20)"
_COLLAPSED = f"""ca AS (SELECT query_id, len({sql_tokens('raw_q')}) AS words, regexp_replace({sql_normalize('raw_q')}, '{_NOTWORD}', '', 'g') AS c FROM queries_v),
        cb AS (SELECT query_id, words, c FROM ca WHERE (length(c) >= 5 OR regexp_matches(c, '^[a-z]{{2,5}}[0-9]{{1,4}}$')) AND length(c) <= 64),
        cp AS (SELECT product_id, popularity, {sql_normalize('title')} || chr(10) || {sql_normalize('tags')} || chr(10) || {sql_normalize('brand')} AS names, unnest([{{'f': 'title', 't': {sql_tokens('title')}}}, {{'f': 'tags', 't': {sql_tokens('tags')}}}, {{'f': 'brand', 't': {sql_tokens('brand')}}}]) AS x FROM products_v),
        cr AS (SELECT product_id, popularity, names, x.f AS f, unnest(list_transform(range(1, len(x.t) + 1), lambda i: array_to_string(x.t[i:], ''))) AS rest FROM cp),
        ch AS (SELECT query_id, product_id, popularity, bool_or(f = 'title') AS title_match FROM cb JOIN cr ON left(rest, 3) = left(c, 3) AND starts_with(rest, c) AND (words > 1 OR NOT contains(names, c)) GROUP BY ALL)"""
_MERGE = "partial, coverage DESC, tm DESC, (sm AND NOT tm) DESC, score DESC, seq"
_SOFT = "(SELECT *, count(*) FILTER (WHERE held = needed) OVER (PARTITION BY query_id) AS full_hits FROM k WHERE needed >= 2)"
#: Keyword search as a whole: kwf(query_id, rank, product_id, match_type, score, solid).
SEARCH = f"""{_PROFILE}, {_POSTINGS}, {_hits()}, {_SKU}, {_COLLAPSED},
shape AS (SELECT query_id, count(*) AS words, max(needed) AS needed FROM prof GROUP BY query_id),
fullh AS (SELECT query_id, product_id, false AS partial, coverage, title_hits > 0 AS tm, field_hits > 0 AS sm, score, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS seq FROM k WHERE held = needed QUALIFY seq <= 20),
spaced AS (SELECT ch.query_id, product_id, title_match, row_number() OVER (PARTITION BY ch.query_id ORDER BY popularity DESC, product_id) AS r FROM ch JOIN shape ON ch.query_id = shape.query_id AND shape.needed > 0 QUALIFY r <= 20),
whole AS (SELECT * FROM fullh UNION ALL SELECT query_id, product_id, false, 1.0::double, title_match, NOT title_match, 9.0::double, 20 + r FROM spaced WHERE (query_id, product_id) NOT IN (SELECT (query_id, product_id) FROM fullh)),
thin AS (SELECT query_id FROM shape LEFT JOIN (SELECT query_id, count(*) AS n FROM whole GROUP BY query_id) USING (query_id) WHERE coalesce(n, 0) < 3 AND words > 1),
soft AS (SELECT query_id, product_id, true AS partial, coverage, title_hits > 0 AS tm, field_hits > 0 AS sm, score, 40 + row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS seq
    FROM (SELECT * REPLACE (round(score * 0.5, 7) AS score) FROM {_SOFT} WHERE full_hits < 3 AND held < needed AND held >= ceil(needed * 0.5) AND query_id IN (SELECT query_id FROM thin)) QUALIFY seq <= 60),
one AS (SELECT * FROM (SELECT * FROM whole UNION ALL SELECT * FROM soft) QUALIFY row_number() OVER (PARTITION BY query_id, product_id ORDER BY {_MERGE}) = 1),
txt AS (SELECT query_id, product_id, CASE WHEN partial THEN 'partial' ELSE 'text' END AS match_type, score, row_number() OVER (PARTITION BY query_id ORDER BY {_MERGE}, product_id) AS rank FROM one QUALIFY rank <= 20),
fnd AS (SELECT query_id, product_id, 'sku' AS match_type, CASE WHEN exact THEN 2000000.0::double ELSE 1000000.0::double END AS score, rank, 0 AS source FROM sk
    UNION ALL SELECT *, 1 FROM txt WHERE (query_id, product_id) NOT IN (SELECT (query_id, product_id) FROM sk)),
nothing AS (SELECT * FROM shape WHERE query_id NOT IN (SELECT query_id FROM fnd)),
{_hits(whole=3, only="query_id IN (SELECT query_id FROM nothing WHERE words > 1 AND needed > 0)", x="2")},
every AS (SELECT * FROM fnd
    UNION ALL (SELECT query_id, product_id, CASE WHEN held < needed THEN 'partial' ELSE 'text' END, score, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank, 2 FROM k2 QUALIFY rank <= 20)
    UNION ALL (SELECT n.query_id, product_id, 'intent', 0.0::double, row_number() OVER (PARTITION BY n.query_id ORDER BY stock > 0 DESC, popularity DESC, product_id) AS rank, 3
        FROM nothing n JOIN qt0 USING (query_id), products_v WHERE n.needed = 0 AND list_contains(toks, 'brand') AND (category = 'ECONOMY' OR contains(' ' || array_to_string({sql_tokens('tags')}, ' ') || ' ', ' hot gear ')) QUALIFY rank <= 20)),
kwf AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY source, rank) AS rank, product_id, match_type, score FROM every QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY source, rank) <= 20)"""
SQL = dict(_RAW) | {
    "search_keyword": with_views(f"WITH {SEARCH} SELECT * FROM kwf", "products_v", "queries_v"),
    "kw_strict": _retrieval(_top("held = needed")),
    "kw_any_terms": _retrieval(_top("true"), whole=3),
    "kw_soft_and": _retrieval("SELECT query_id, product_id, held, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY " + _ORDER + ") AS rank FROM (SELECT * REPLACE (round(score * 0.5, 7) AS score) FROM " + _SOFT + " WHERE full_hits < 3 AND held < needed AND held >= ceil(needed * 0.5))) WHERE rank <= 20"),
    "kw_structured": _retrieval(_top("held = needed"), "level > 0"),
    "kw_title_only": _retrieval(_top("held = needed", "CASE WHEN phrase THEN 15.0::double ELSE 10.0::double END"), "level = 1"),
    "kw_sku": with_views(f"WITH {_SKU} SELECT query_id, product_id, rank, CASE WHEN exact THEN 2000000.0::double ELSE 1000000.0::double END AS score FROM sk", "products_v", "queries_v"),
    "kw_collapsed": with_views(f"WITH {_COLLAPSED} SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY popularity DESC, product_id) AS rank, 9.0::double AS score, title_match FROM ch QUALIFY rank <= 20", "products_v", "queries_v"),
    "math_idf": with_views(f"WITH d AS ({_DF}), n AS (SELECT count(*) AS n FROM products_v), g AS (SELECT token, df, n, NOT regexp_matches(token, '^[0-9]+$') AND df / n > 0.15 AS generic FROM d, n) SELECT token, df, generic, round(CASE WHEN generic THEN 0.1 ELSE least(1.0, greatest(0.2, ln(n / (1 + df)) / ln(n))) END, 9) AS weight FROM g", "products_v"),
    "lex_token_df": with_views(_DF, "products_v"),
    "lex_spell_dict": with_views(f"SELECT token, count(*) AS freq FROM (SELECT unnest(list_distinct(list_concat(list_concat({sql_tokens('title')}, {sql_tokens('brand')}), {sql_tokens('tags')}))) AS token FROM products_v) WHERE length(token) >= 2 GROUP BY token", "products_v"),
    "lex_facet_terms": with_views(f"WITH h AS (SELECT product_id, unnest(list_distinct({sql_tokens('specs')})) AS word FROM products_v), t AS (SELECT DISTINCT word AS term FROM h WHERE length(word) >= 3) SELECT term, count(DISTINCT product_id) AS products FROM t JOIN h ON starts_with(word, term) GROUP BY term HAVING count(DISTINCT product_id) >= 20", "products_v"),
    "lex_brand_ambiguous": with_views(f"WITH r AS (SELECT product_id, split_part(title, ' ', 2) AS brand, {_PHRASED} AS text FROM products_v), c AS (SELECT brand, count(*) AS n FROM r GROUP BY brand), o AS (SELECT c.brand, count(*) AS others FROM c JOIN r ON r.brand <> c.brand AND contains(text, ' ' || c.brand || ' ') GROUP BY c.brand) SELECT brand, n, coalesce(others, 0) AS others, coalesce(others, 0) >= greatest(5, 2 * n) AS ambiguous FROM c LEFT JOIN o USING (brand)", "products_v"),
    "lex_titles_with": with_views(f"WITH t AS (SELECT product_id, ' ' || array_to_string({sql_tokens('title')}, ' ') || ' ' AS t FROM products_v) SELECT product_id FROM t WHERE contains(t, ' old ') OR contains(t, ' hot gear ')", "products_v"),
    "etl_server_rows": with_views(rf"""WITH c AS (SELECT *, array_to_string(list_filter(string_split(trim(regexp_replace(tags, '\s+', ' ', 'g')), ' '), lambda t: length(t) > 1 OR regexp_matches(t, '^[0-9]+$')), ' ') AS ctags,
            CASE WHEN length(description) <= 120 THEN description ELSE regexp_replace(CASE WHEN regexp_matches(substring(description, 121, 1), '[\s\p{{Z}}]') THEN substring(description, 1, 120) ELSE regexp_replace(substring(description, 1, 120), '[^\s\p{{Z}}]+\n?$', '') END, '[\s\p{{Z}}]+$', '') END AS cut FROM products_v),
        n AS (SELECT *, {sql_normalize('title')} AS nt, {sql_normalize('ctags')} AS ng, {sql_normalize('brand')} AS nb, regexp_replace({sql_canonical('sku')}, '{_NOTWORD}', '', 'g') AS ns FROM c)
        SELECT product_id, title, description, trim(nt || ' ' || ns) AS normalized_title, {sql_normalize('cut')} AS normalized_desc, {sql_normalize('specs')} AS normalized_specs, ng AS normalized_tags, nb AS normalized_brand, {sql_normalize('category')} AS normalized_category,
               substring(concat_ws(' ', nullif(regexp_replace(nt, '{_NOTWORD}', '', 'g'), ''), nullif(regexp_replace(nb, '{_NOTWORD}', '', 'g'), ''), nullif(regexp_replace(ng, '{_NOTWORD}', '', 'g'), '')), 1, 700) AS normalized_collapsed,
               ctags AS tags, brand, category, '' AS model, sku, ns AS normalized_sku, price::double AS price, stock, '' AS url, '' AS image, popularity FROM n""", "products_v"),
}
