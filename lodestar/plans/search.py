"""Queries for vectors, hybrid ranking, rewriting, evaluation and lifecycle, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, tokenize
from ..operators import evaluate as E
from ..operators import lexicon as X
from ..operators import lifecycle as L
from ..operators import rewrite as R
from ..operators import vector as V
from ..operators.retrieve import in_order, intent_hits, merge_best, profile
from ..operators.search import hybrid_search, keyword_search, resolve_intents
from .catalog import _ORDER, _POSTINGS, _PROFILE, SEARCH, _hits, intents, sql_normalize, sql_tokens
from .views import RATIO, index_of, view, with_views


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return V.top_k(_asked(v), v, 10, -1.0)


def vec_cosine_floor(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return V.top_k(_asked(v), v, 100, 0.25)


def vec_blocks(spark: SparkSession, d: str) -> DataFrame:
    """As ``vec_topk``, in many blocks of queries and parts of vectors: every pair of them returns candidates that are merged."""
    v = _vectors(spark, d)
    return V.top_k(_asked(v), v, 10, -1.0, (4, 150))


def _kw_sem(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Strict hits of the queries, and as neighbours those of the vector that has the query's number."""
    kw = index_of(spark, d).strict(view(spark, d, "queries_v"), 1000).select("query_id", "product_id", "score", (F.col("title_hits") == F.col("needed")).alias("solid"))
    return kw, _neighbours(spark, d, view(spark, d, "queries_v"))


def _neighbours(spark: SparkSession, d: str, queries: DataFrame) -> DataFrame:
    v = _vectors(spark, d)
    asked = queries.select("query_id", F.col("query_id").alias("id")).join(v, "id").drop("id")
    return V.top_k(asked, v, 100, 0.1).select("query_id", F.col("id").alias("product_id"), F.col("score").alias("cosine"))


def search_full(spark: SparkSession, d: str) -> DataFrame:
    """From query text to the final list: codes pinned, keyword hits and neighbours blended."""
    index, queries = index_of(spark, d), view(spark, d, "queries_v")
    words = keyword_search(index, queries, intents(spark)).withColumn("solid", F.col("match_type") == "text")
    return hybrid_search(index, queries, words, _neighbours(spark, d, queries)).select("query_id", "rank", "product_id", F.round("score", 6).alias("score"), "pinned")


def hyb_blend(spark: SparkSession, d: str) -> DataFrame:
    out = V.blend(*_kw_sem(spark, d))
    return out.select("query_id", "product_id", "solid", F.round("relevance", 6).alias("relevance"))


def _boosted(spark: SparkSession, d: str) -> DataFrame:
    queries = view(spark, d, "queries_v").select("query_id", F.array(tokenize(normalize("raw_q"))).alias("variants"))
    return V.boosted(V.blend(*_kw_sem(spark, d)), view(spark, d, "products_v"), queries)


def hyb_boosts(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d).select("query_id", "product_id", "score")


def hyb_tail_cap(spark: SparkSession, d: str) -> DataFrame:
    return V.tail_capped(_boosted(spark, d)).select("query_id", "product_id", "score", "rank")


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    return X.spell_dictionary(view(spark, d, "products_v"))


def _misspelt(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the catalog with one letter dropped, two swapped, or one more."""
    w = _dictionary(spark, d).where(F.length("token") >= 4).select(F.col("token").alias("w"))
    made = F.array(F.concat(F.substring("w", 1, 2), F.expr("substring(w, 4)")), F.concat(F.substring("w", 1, 1), F.substring("w", 3, 1), F.substring("w", 2, 1), F.expr("substring(w, 4)")), F.concat("w", F.lit("x")))
    return w.select(F.explode(made).alias("token")).distinct()


def q_spell(spark: SparkSession, d: str) -> DataFrame:
    return R.corrections(_misspelt(spark, d), _dictionary(spark, d))


def q_profile(spark: SparkSession, d: str) -> DataFrame:
    out = profile(view(spark, d, "queries_v"), index_of(spark, d).products, RATIO)
    return out.select("query_id", F.col("at").cast("long").alias("at"), "token", "required", F.round("weight", 6).alias("weight"), F.round("total", 6).alias("total"))


def q_phrases(spark: SparkSession, d: str) -> DataFrame:
    known = view(spark, d, "products_v").select(F.array_join(tokenize(normalize("brand")), " ").alias("phrase")).union(spark.createDataFrame([("hot gear",), ("gear",), ("economy small",), ("small",)], "phrase string"))
    return R.phrases_in(view(spark, d, "queries_v"), known)


def q_entity_status(spark: SparkSession, d: str) -> DataFrame:
    p, q = view(spark, d, "products_v"), view(spark, d, "queries_v").where("raw_q like '%Brand#%'")
    brands = p.select(F.array_join(tokenize(normalize("brand")), " ").alias("phrase")).distinct()
    named = R.phrases_in(q, brands).select("query_id", F.col("phrase").alias("brand"))
    hits = index_of(spark, d).any_terms(q, 50).select("query_id", "product_id")
    return R.entity_statuses(hits, p, named).select("query_id", "product_id", "brand_status", "brand_active")


def q_intent(spark: SparkSession, d: str) -> DataFrame:
    rows = [(1, ["ECONOMY"], ["hot gear"]), (2, [], ["red"]), (3, ["PROMO", "LARGE"], [])]
    return intent_hits(spark.createDataFrame(rows, "query_id long, categories array<string>, tags array<string>"), view(spark, d, "products_v")).select("query_id", "product_id", "rank")


def kw_merge(spark: SparkSession, d: str) -> DataFrame:
    index, q = index_of(spark, d), view(spark, d, "queries_v")
    mark = lambda df, partial, seq: df.select("query_id", "product_id", F.lit(partial).alias("partial"), "coverage", (F.col("title_hits") > 0).alias("title_match"), (F.col("field_hits") > 0).alias("spec_match"), "score", F.lit(seq).alias("seq"))
    return merge_best(mark(index.strict(q), False, 0).unionAll(mark(index.soft_and(q), True, 1))).select("query_id", "product_id", "score", "rank")


def _judgements(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored results, the queries, and stored pairs (query_id, product_id): every third product is relevant to queries whose words, none twice, its title holds."""
    index, q = index_of(spark, d), view(spark, d, "queries_v")
    results = X.kept(index.title_only(q, 10).select("query_id", "rank", "product_id"), "results")
    titles = X.kept(index.products.where("product_id % 3 = 0").select("product_id", F.array_sort(F.array_distinct(tokenize(F.lower("title")))).alias("held")), "title-words")
    return results, q, X.kept(E.titles_holding(q.select("query_id", tokenize(F.lower("raw_q")).alias("words")), titles), "relevant")


def eval_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return E.per_query_of_pairs(*_judgements(spark, d)).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"))


def eval_ndcg_mrr(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(E.per_query_of_pairs(*_judgements(spark, d)))


def eval_compare(spark: SparkSession, d: str) -> DataFrame:
    results, q, relevant = _judgements(spark, d)
    before = E.per_query_of_pairs(results.where("query_id % 4 <> 1"), q.where("query_id % 9 <> 0"), relevant)
    return E.compare(before, E.per_query_of_pairs(results.where("rank > 1"), q.where("query_id % 7 <> 0"), relevant))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("q"), (F.col("user_id") % 40).cast("string")).alias("query"), (F.col("event_id") % 500).alias("product_id"), F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 5 == 0), "1").otherwise("0").alias("mark"), F.when(F.col("user_id") % 4 == 0, "Off").alias("note"))


def eval_golden_finish(spark: SparkSession, d: str) -> DataFrame:
    return E.finish(_marks(spark, d)).select("query", F.array_join(F.transform("relevant", lambda x: x.cast("string")), ";").alias("relevant"), "state")


def life_diff(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    staged = part.where("p_partkey % 10 <> 3").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return L.difference(part.where("p_partkey % 11 <> 5"), staged, "p_partkey")


def life_validate(spark: SparkSession, d: str) -> DataFrame:
    return L.vector_report(_vectors(spark, d))


def ids_in_order(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, [5, 3, 999999, 8]), (2, [7])], "query_id long, ids array<bigint>")
    return in_order(rows, view(spark, d, "products_v")).select("query_id", F.col("at").cast("long").alias("at"), "product_id", "title")


QUERIES = {f.__name__: f for f in (
    search_full, vec_topk, vec_cosine_floor, vec_blocks, hyb_blend, hyb_boosts, hyb_tail_cap, q_spell, q_profile, q_phrases, q_entity_status, q_intent, kw_merge,
    eval_precision_recall, eval_ndcg_mrr, eval_compare, eval_golden_finish, life_diff, life_validate, ids_in_order,
)}

_TOPK = "SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(v.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE score >= {least}) WHERE rank <= {k}"
_NEAR = "nb AS (SELECT query_id, product_id, cosine FROM (SELECT q.query_id, v.vec_id AS product_id, round(list_dot_product(v.embedding::double[], u.embedding::double[]) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) / sqrt(list_dot_product(u.embedding::double[], u.embedding::double[])), 6) AS cosine FROM queries_v q JOIN embeddings u ON u.vec_id = q.query_id, embeddings v) WHERE cosine >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, product_id) <= 100)"
_BLEND_OF = """b AS (SELECT query_id, product_id, score, cosine, coalesce(solid, false) AS solid, coalesce(max(score) OVER w, 0) AS ts, coalesce(max(cosine) OVER w, 0) AS tc FROM kws FULL JOIN sem USING (query_id, product_id) WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT query_id, product_id, solid, 0.4 * CASE WHEN ts > 0 THEN greatest(0, coalesce(score, 0)) / ts ELSE 0 END + 0.6 * CASE WHEN tc > 0 THEN greatest(0, coalesce(cosine, CASE WHEN solid THEN least(0.4, tc) ELSE 0 END)) / tc ELSE 0 END AS relevance FROM b),
f AS (SELECT * FROM r WHERE relevance >= 0.45 OR solid)"""
_SEM = "sem AS (SELECT * FROM nb)"
_BLEND = f"{_PROFILE}, {_POSTINGS}, {_hits()}, kws AS (SELECT query_id, product_id, score, title_hits = needed AS solid FROM k WHERE held = needed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) <= 1000), {_NEAR}, {_SEM}, {_BLEND_OF}"
_BOOST_OF = f"""q AS (SELECT query_id, {sql_tokens('raw_q')} AS toks FROM queries_v),
j AS (SELECT f.*, stock, popularity, {sql_tokens('brand')} AS bw, {sql_tokens('category')} AS cw, ' ' || array_to_string({sql_tokens('tags')}, ' ') || ' ' AS tw, toks, max(popularity) OVER (PARTITION BY query_id) AS top FROM f JOIN products_v USING (product_id) JOIN q USING (query_id)),
z AS (SELECT query_id, product_id, solid, round(relevance * (1.0 + CASE WHEN stock > 0 THEN 0.1 ELSE 0 END + CASE WHEN top > 0 THEN 0.1 * popularity / top ELSE 0 END + CASE WHEN list_has_all(toks, bw) THEN 0.15 ELSE 0 END + CASE WHEN list_has_all(toks, cw) THEN 0.1 ELSE 0 END + CASE WHEN len(toks) >= 2 AND contains(tw, ' ' || array_to_string(toks, ' ') || ' ') THEN 0.1 ELSE 0 END), 6) AS score FROM j)"""
_BOOST = f"{_BLEND}, {_BOOST_OF}"
_DICT = f"dict AS (SELECT token, count(*) AS freq FROM (SELECT unnest(list_distinct(list_concat(list_concat({sql_tokens('title')}, {sql_tokens('brand')}), {sql_tokens('tags')}))) AS token FROM products_v) WHERE length(token) >= 2 GROUP BY token)"
#: corrected(token, correction) of the words u0(token) by the dictionary dict(token, freq).
CORRECTED = """u1 AS (SELECT token, CASE WHEN regexp_full_match(token, '\\p{L}+[0-9]+') THEN regexp_extract(token, '^\\p{L}+') ELSE token END AS word FROM u0 WHERE length(token) >= 4 AND NOT regexp_full_match(token, '[0-9]+') AND token NOT IN (SELECT token FROM dict)),
        u AS (SELECT *, substring(token, length(word) + 1) AS digits, CASE WHEN length(word) >= 8 AND regexp_full_match(word, '[a-z0-9]+') THEN 2 ELSE 1 END AS reach FROM u1 WHERE length(word) >= 4 AND word NOT IN (SELECT token FROM dict)),
        d AS (SELECT token AS term, freq FROM dict WHERE freq >= 2),
        ux AS (SELECT u.token, digits, term, freq, CASE WHEN list_contains(list_transform(range(1, length(word)), lambda i: substring(word, 1, i - 1) || substring(word, i + 1, 1) || substring(word, i, 1) || substring(word, i + 2)), term) THEN 0 ELSE levenshtein(word, term) END AS edits, word, reach FROM u, d),
        uy AS (SELECT * FROM ux WHERE edits = 0 OR (edits <= reach AND NOT contains(word, term) AND (word[1] = term[1] OR (length(word) > 6 AND edits <= 1)))),
        corrected AS (SELECT token, term || digits AS correction FROM uy QUALIFY row_number() OVER (PARTITION BY token ORDER BY edits, freq DESC, term) = 1)"""
_W = r"[\p{L}\p{N}]+"
_JUDGED = f"""{_PROFILE}, {_POSTINGS}, {_hits('level = 1')},
res0 AS (SELECT query_id, product_id, rank FROM (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS rank FROM (SELECT * REPLACE (CASE WHEN phrase THEN 15.0::double ELSE 10.0::double END AS score) FROM k WHERE held = needed)) WHERE rank <= 10),
qw AS (SELECT query_id, unnest(regexp_extract_all(lower(raw_q), '{_W}')) AS w, len(regexp_extract_all(lower(raw_q), '{_W}')) AS n FROM queries_v),
tw AS (SELECT product_id, unnest(list_distinct(regexp_extract_all(lower(title), '{_W}'))) AS w FROM products_v WHERE product_id % 3 = 0),
rel AS (SELECT query_id, product_id FROM qw JOIN tw USING (w) GROUP BY query_id, product_id, n HAVING count(DISTINCT w) = n)"""


def _judge(x: str, results: str, queries: str) -> str:
    """CTE pq (with a suffix): the measures of each query over some results and queries."""
    return f"""res{x} AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM res0 WHERE {results}),
a{x} AS (SELECT query_id, (SELECT count(*) FROM rel WHERE rel.query_id = q.query_id) AS nrel, (SELECT count(*) FROM res{x} r WHERE r.query_id = q.query_id) AS returned FROM queries_v q WHERE {queries}),
b{x} AS (SELECT r.query_id, count(*) AS hits, min(rank) AS first_rank, sum(1.0 / log2(rank + 1.0)) AS gain FROM res{x} r JOIN rel ON rel.query_id = r.query_id AND rel.product_id = r.product_id GROUP BY r.query_id),
pq{x} AS (SELECT query_id, returned, first_rank, CASE WHEN nrel = 0 THEN (returned = 0)::int::double ELSE coalesce(hits, 0) / 10 END AS "precision", CASE WHEN nrel = 0 THEN (returned = 0)::int::double ELSE coalesce(hits, 0) / nrel END AS recall,
       CASE WHEN nrel = 0 THEN (returned = 0)::int::double ELSE coalesce(gain, 0) / list_sum(list_transform(range(1, least(10, nrel) + 1), lambda i: 1.0 / log2(i + 1.0))) END AS ndcg FROM a{x} LEFT JOIN b{x} USING (query_id))"""


_EVAL = f"{_JUDGED}, {_judge('', 'true', 'true')}"
_BRANDS = f"brs AS (SELECT DISTINCT array_to_string({sql_tokens('brand')}, ' ') AS phrase FROM products_v)"
_MERGED = "mk AS (SELECT query_id, product_id, false AS partial, coverage, title_hits > 0 AS tm, field_hits > 0 AS sm, score, 0 AS seq, row_number() OVER (PARTITION BY query_id ORDER BY " + _ORDER + ") AS r FROM k WHERE held = needed QUALIFY r <= 20 UNION ALL (SELECT query_id, product_id, true, coverage, title_hits > 0, field_hits > 0, score, 1, row_number() OVER (PARTITION BY query_id ORDER BY " + _ORDER + ") AS r FROM (SELECT * REPLACE (round(score * 0.5, 7) AS score) FROM (SELECT *, count(*) FILTER (WHERE held = needed) OVER (PARTITION BY query_id) AS full_hits FROM k WHERE needed >= 2) WHERE full_hits < 3 AND held < needed AND held >= ceil(needed * 0.5)) QUALIFY r <= 20))"
SQL = {
    "kw_merge": with_views(f"WITH {_PROFILE}, {_POSTINGS}, {_hits()}, {_MERGED}, o AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY query_id, product_id ORDER BY partial, coverage DESC, tm DESC, (sm AND NOT tm) DESC, score DESC, seq) = 1) SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id ORDER BY partial, coverage DESC, tm DESC, (sm AND NOT tm) DESC, score DESC, seq, product_id) AS rank FROM o QUALIFY rank <= 20", "products_v", "queries_v"),
    "search_full": with_views(f"""WITH {SEARCH}, {_NEAR}, cat AS (SELECT product_id FROM products_v), kws AS (SELECT query_id, product_id, score, match_type = 'text' AS solid FROM kwf WHERE match_type <> 'sku'), sem AS (SELECT * FROM nb WHERE product_id IN (SELECT product_id FROM cat)), {_BLEND_OF}, {_BOOST_OF},
        tc AS (SELECT *, sum(CASE WHEN solid THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY score DESC, product_id ROWS UNBOUNDED PRECEDING) AS o FROM z),
        fin AS (SELECT query_id, product_id, rank, NULL::double AS score, true AS pinned FROM kwf WHERE match_type = 'sku'
            UNION ALL (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank, score, false FROM tc WHERE (solid OR o <= 40) AND (query_id, product_id) NOT IN (SELECT (query_id, product_id) FROM kwf WHERE match_type = 'sku')))
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, rank) AS rank, product_id, round(score, 6) AS score, pinned FROM fin QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, rank) <= 20""", "products_v", "queries_v"),
    "eval_precision_recall": with_views(f"WITH {_EVAL} SELECT query_id, round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall, round(ndcg, 6) AS ndcg FROM pq", "products_v", "queries_v"),
    "eval_ndcg_mrr": with_views(f"WITH {_EVAL} SELECT count(*) AS queries, round(avg(\"precision\"), 4) AS \"precision\", round(avg(recall), 4) AS recall, round(avg(coalesce(1.0 / first_rank, 0)), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg((first_rank IS NOT NULL)::int), 4) AS success, round(avg((returned = 0)::int), 4) AS zero_rate FROM pq", "products_v", "queries_v"),
    "eval_compare": with_views(f"""WITH {_JUDGED}, {_judge('1', 'query_id % 4 <> 1', 'query_id % 9 <> 0')}, {_judge('2', 'rank > 1', 'query_id % 7 <> 0')}
        SELECT query_id, round(x.ndcg, 6) AS "before", round(y.ndcg, 6) AS "after", CASE WHEN x.ndcg IS NULL THEN 'added' WHEN y.ndcg IS NULL THEN 'removed' WHEN y.ndcg > x.ndcg THEN 'better' WHEN y.ndcg < x.ndcg THEN 'worse' ELSE 'same' END AS state FROM pq1 x FULL JOIN pq2 y USING (query_id)""", "products_v", "queries_v"),
    "q_phrases": with_views(f"""WITH {_BRANDS}, kn AS (SELECT phrase FROM brs UNION SELECT unnest(['hot gear', 'gear', 'economy small', 'small'])),
        t AS (SELECT query_id, {sql_tokens('raw_q')} AS t FROM queries_v), r AS (SELECT query_id, i.range - 1 AS a, n.range AS sz, array_to_string(t[i.range:i.range + n.range - 1], ' ') AS phrase FROM t, range(1, 9) i, range(1, 5) n WHERE i.range + n.range - 1 <= len(t)),
        f AS (SELECT * FROM r JOIN kn USING (phrase))
        SELECT query_id, cast(a AS int) AS "at", cast(sz AS int) AS size, phrase FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.query_id = x.query_id AND x.a < y.a + y.sz AND y.a < x.a + x.sz AND (y.sz > x.sz OR (y.sz = x.sz AND y.a < x.a)))""", "products_v", "queries_v"),
    "q_entity_status": with_views(f"""WITH {_PROFILE}, {_POSTINGS}, {_hits(whole=3, only="query_id IN (SELECT query_id FROM queries_v WHERE raw_q LIKE '%Brand#%')")}, {_BRANDS},
        nm AS (SELECT query_id, phrase FROM qt0 JOIN queries_v USING (query_id), brs WHERE raw_q LIKE '%Brand#%' AND contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || phrase || ' ')),
        ht AS (SELECT query_id, product_id FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) <= 50),
        st AS (SELECT query_id, product_id, CASE WHEN query_id NOT IN (SELECT query_id FROM nm) THEN 0 WHEN (query_id, array_to_string({sql_tokens('brand')}, ' ')) IN (SELECT (query_id, phrase) FROM nm) THEN 1 ELSE -1 END AS brand_status FROM ht JOIN products_v USING (product_id))
        SELECT *, max(brand_status = 1) OVER (PARTITION BY query_id) AS brand_active FROM st""", "products_v", "queries_v"),
    "vec_topk": _TOPK.format(least=-1.0, k=10),
    "vec_blocks": _TOPK.format(least=-1.0, k=10),
    "vec_cosine_floor": _TOPK.format(least=0.25, k=100),
    "hyb_blend": with_views(f"WITH {_BLEND} SELECT query_id, product_id, solid, round(relevance, 6) AS relevance FROM f", "products_v", "queries_v"),
    "hyb_boosts": with_views(f"WITH {_BOOST} SELECT query_id, product_id, score FROM z", "products_v", "queries_v"),
    "hyb_tail_cap": with_views(f"WITH {_BOOST}, t AS (SELECT *, sum(CASE WHEN solid THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY score DESC, product_id ROWS UNBOUNDED PRECEDING) AS o FROM z) SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM t WHERE solid OR o <= 40", "products_v", "queries_v"),
    "q_spell": with_views(f"""WITH {_DICT}, w AS (SELECT token AS w FROM dict WHERE length(token) >= 4),
        u0 AS (SELECT DISTINCT unnest([substring(w, 1, 2) || substring(w, 4), substring(w, 1, 1) || substring(w, 3, 1) || substring(w, 2, 1) || substring(w, 4), w || 'x']) AS token FROM w),
        {CORRECTED} SELECT token, correction FROM corrected""", "products_v"),
    "q_profile": with_views(f"WITH {_PROFILE} SELECT query_id, cast(pos - 1 AS bigint) AS \"at\", token, NOT generic AS required, round(w, 6) AS weight, round(total, 6) AS total FROM prof", "products_v", "queries_v"),
    "q_intent": with_views(f"""WITH i AS (SELECT * FROM (VALUES (1, 'c', 'ECONOMY'), (1, 't', 'hot gear'), (2, 't', 'red'), (3, 'c', 'PROMO'), (3, 'c', 'LARGE')) AS v(query_id, kind, name)),
        h AS (SELECT DISTINCT i.query_id, product_id, popularity, stock > 0 AS st FROM i JOIN products_v ON CASE WHEN kind = 'c' THEN category = name ELSE contains(' ' || array_to_string({sql_tokens('tags')}, ' ') || ' ', ' ' || name || ' ') END)
        SELECT cast(query_id AS bigint) AS query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY st DESC, popularity DESC, product_id) AS rank FROM h QUALIFY rank <= 20""", "products_v"),
    "eval_golden_finish": "WITH m AS (SELECT 'q' || cast(user_id % 40 AS string) AS query, event_id % 500 AS product_id, user_id % 3 = 0 AND event_id % 5 = 0 AS yes, user_id % 4 = 0 AS off FROM events) SELECT query, coalesce(array_to_string(list_sort(list_distinct(list(product_id) FILTER (WHERE yes))), ';'), '') AS relevant, CASE WHEN bool_or(yes) THEN 'judged' WHEN bool_or(off) THEN 'negative' ELSE 'skipped' END AS state FROM m GROUP BY query",
    "life_diff": "WITH a AS (SELECT * FROM part WHERE p_partkey % 11 <> 5), b AS (SELECT * REPLACE (cast(CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS int) AS p_size) FROM part WHERE p_partkey % 10 <> 3) SELECT count(a.p_partkey) AS live, count(b.p_partkey) AS staged, count(*) FILTER (WHERE a.p_partkey IS NULL) AS added, count(*) FILTER (WHERE b.p_partkey IS NULL) AS removed, count(*) FILTER (WHERE a.p_size <> b.p_size) AS changed FROM a FULL JOIN b ON a.p_partkey = b.p_partkey",
    "life_validate": "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, cast(min(len(embedding)) AS int) AS least_dim, cast(max(len(embedding)) AS int) AS most_dim, bool_and(len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0) AS finite, bool_and(abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) <= 0.001) AS \"unit\" FROM embeddings",
    "ids_in_order": with_views("WITH i AS (SELECT * FROM (VALUES (1, 0, 5), (1, 1, 3), (1, 2, 999999), (1, 3, 8), (2, 0, 7)) AS v(query_id, pos, product_id)) SELECT cast(query_id AS bigint) AS query_id, cast(pos AS bigint) AS \"at\", p.product_id, title FROM i JOIN products_v p ON p.product_id = i.product_id", "products_v"),
}
