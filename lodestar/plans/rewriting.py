"""Queries for spellings, alias hits, recovery and entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import normalize, tokenize
from ..operators import entities as N
from ..operators import lexicon as X
from ..operators import rewrite as R
from ..operators import variants as A
from ..operators.search import complete_search
from .catalog import _NOTWORD, _ORDER, _POSTINGS, _PROFILE, _hits, intents, sql_normalize, sql_tokens
from .search import _BLEND_OF, _BOOST_OF, _DICT, _NEAR, CORRECTED, _kw_sem
from ..operators import vector as V
from ..operators.vector import mock_embedding
from .views import RATIO, index_of, view, with_views

#: The owner's alias groups for the driver's catalog.
GROUPS = (
    ("gizmo", "gadget"), ("hot gear", "warm gear", "gear"), ("small", "little", "tiny"), ("brand 7", "acme"), ("brand11", "zenith", "plate"), ("bluewidget", "azure widget", "anvil"), ("gadget", "gimcrack"),
)


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(list, GROUPS))), "group long, terms array<string>")


def alias_words(spark: SparkSession) -> DataFrame:
    return groups(spark).select(F.explode("terms").alias("term")).select(F.explode(tokenize(normalize("term"))).alias("token")).distinct()


def q_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of every query."""
    out = A.variants(view(spark, d, "queries_v"), A.alternatives(groups(spark)), alias_words(spark))
    return out.select("query_id", F.col("seq").cast("int").alias("seq"), F.array_join("tokens", " ").alias("variant"))


def kw_variants(spark: SparkSession, d: str) -> DataFrame:
    """Hits of every query and of its other spellings."""
    out = A.variant_hits(index_of(spark, d), view(spark, d, "queries_v"), A.alternatives(groups(spark)), alias_words(spark))
    return out.select("query_id", "product_id", "score", "title_match", "name_all", "rank")


#: What the driver's catalog can be asked for besides its brands: names that are also common words, platforms, conditions.
AMBIGUOUS, PLATFORMS = ("promo", "red ring"), {"l": ("large",), "s": ("small", "economy")}
CONDITIONS, USED = {"used": ("old",), "new": ("new", "new rod")}, ("old",)


def entities(spark: SparkSession, d: str) -> N.Entities:
    products = index_of(spark, d).products
    brands = products.select("brand").distinct().select(N.phrase("brand").alias("phrase")).distinct().withColumn("ambiguous", F.lit(False))
    return N.Entities(brands.unionByName(spark.createDataFrame([(b, True) for b in AMBIGUOUS], "phrase string, ambiguous boolean")), PLATFORMS, X.titles_with(products, USED), CONDITIONS)


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What each query names, and the statuses of its 50 best products with any of its words."""
    index, queries, alts = index_of(spark, d), view(spark, d, "queries_v"), A.alternatives(groups(spark))
    asked = A.numbered_variants(A.variants(queries, alts, alias_words(spark)))
    known = entities(spark, d)
    named = N.recognized(asked, index.profile(asked), known, alts)
    return named, N.statuses(index.any_terms(queries, 50), named, N.signals(index.products, known, alts))


def q_entities(spark: SparkSession, d: str) -> DataFrame:
    """Status of every candidate in the three dimensions, and which are active."""
    return _entities(spark, d)[1].select("query_id", "product_id", "brand", "platform", "condition", "brand_active", "platform_active")


def q_recognized(spark: SparkSession, d: str) -> DataFrame:
    """What every query names."""
    lists = ("brands", "typed", "ambiguous", "platforms", "rest")
    return _entities(spark, d)[0].select("query_id", *(F.array_join(c, "|").alias(c) for c in lists), "condition")


def q_brand_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Whether the brands that queries name are carried, mentioned or missing among their candidates."""
    return N.evidence(*_entities(spark, d))


def q_recover(spark: SparkSession, d: str) -> DataFrame:
    """What is tried instead of misspelt queries, in other spacing and of another key layout, and found."""
    index, queries = index_of(spark, d), view(spark, d, "typos_v")
    search = lambda q: A.as_hits(index.strict(q), F.col("rank"))
    own = index.strict(queries).groupBy("query_id").agg(F.count(F.lit(1)).alias("full"))
    terms = groups(spark).select(F.explode("terms").alias("term"))
    first, _ = R.recover(queries, own, index.dictionary, search, terms)
    return first.select("query_id", "step", "rewritten", "full")


def search_complete(spark: SparkSession, d: str) -> DataFrame:
    """Every stage of the search over typed and misspelt queries: spellings, recovery, entities, gated neighbours."""
    index = index_of(spark, d)
    typed, typos = view(spark, d, "queries_v"), view(spark, d, "typos_v")
    queries = X.kept(typed.select(F.col("query_id").cast("long").alias("query_id"), "raw_q").unionByName(typos.select((F.col("query_id") + 1_000_000_000).alias("query_id"), "raw_q")), "queries")
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    embed = lambda texts: texts.select("query_id", mock_embedding(F.col("text")).alias("embedding"))
    out, shown = complete_search(index, queries, groups(spark), index.dictionary, entities(spark, d), intents(spark), embed, vectors)
    return out.join(shown, "query_id", "left").select("query_id", "rank", "product_id", F.round("score", 6).alias("score"), "pinned", "did_you_mean", "applied")


def _with_entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blended hits with what named entities make of them, the products, and the queries' words."""
    index, queries, alts = index_of(spark, d), view(spark, d, "queries_v"), A.alternatives(groups(spark))
    words, near = (X.kept(df, "both") for df in _kw_sem(spark, d))
    near = near.join(index.products.select("product_id"), "product_id", "left_semi")
    asked = A.numbered_variants(A.variants(queries, alts, alias_words(spark)))
    known = entities(spark, d)
    named = N.recognized(asked, index.profile(asked), known, alts)
    every = words.select("query_id", "product_id").union(near.select("query_id", "product_id")).distinct()
    marks = X.kept(N.counted(N.statuses(every, named, N.signals(index.products, known, alts))).select("query_id", "product_id", "brand", "brand_active", "lifted", "demoted"), "marks")
    safe = N.exempt(F.col("solid"), F.col("brand_active"), F.col("brand"))
    words = words.join(marks, ["query_id", "product_id"], "left").select("query_id", "product_id", "score", safe.alias("solid"))
    blended = V.blend(words, near).join(marks.select("query_id", "product_id", "lifted", "demoted"), ["query_id", "product_id"], "left").fillna(0, ["lifted", "demoted"])
    return blended, index.products, queries.select("query_id", F.array(tokenize(normalize("raw_q"))).alias("variants"))


def hyb_entities(spark: SparkSession, d: str) -> DataFrame:
    """The blend of strict hits and neighbours where named entities lift, demote and take the exemption from the floor."""
    return V.tail_capped(V.boosted(*_with_entities(spark, d))).select("query_id", "product_id", "solid", "score", "rank")


def hyb_explained(spark: SparkSession, d: str) -> DataFrame:
    """The parts of every score of that blend."""
    return V.explained(*_with_entities(spark, d))


QUERIES = {f.__name__: f for f in (q_variants, kw_variants, q_recognized, q_entities, q_brand_evidence, hyb_entities, hyb_explained, q_recover, search_complete)}

_GROUPS = ", ".join(f"({i}, {j}, '{t}')" for i, g in enumerate(GROUPS) for j, t in enumerate(g))
_WORDS = "[" + ", ".join(f"'{w}'" for w in sorted({w for g in GROUPS for t in g for w in t.split()})) + "]"


def _joins(i: str) -> str:
    """Whether the word at ``i`` is a short number that belongs to the word before it."""
    number = lambda n: f"regexp_full_match(t[{n}], '[0-9]{{1,2}}')"
    return f"coalesce({number(i)} AND (regexp_full_match(t[{i} - 1], '[a-z]+') OR (list_contains({_WORDS}, t[{i} - 1]) AND NOT {number(f'{i} - 1')})), false)"


def variants_sql(queries: str, x: str = "") -> str:
    """CTEs up to va(query_id, seq, variant), with a suffix, of the table ``queries`` (query_id, raw_q)."""
    return f"""
ag{x} AS (SELECT * FROM (VALUES {_GROUPS}) AS v(g, pos, phrase)),
al{x} AS (SELECT phrase, alt, row_number() OVER (PARTITION BY phrase ORDER BY o) - 1 AS a FROM (SELECT p.phrase, o.phrase AS alt, min((o.g, o.pos)) AS o FROM ag{x} p JOIN ag{x} o ON p.g = o.g AND p.phrase <> o.phrase GROUP BY ALL)),
de{x} AS (SELECT replace(phrase, ' ', '') AS k, min(phrase) AS phrase FROM al{x} GROUP BY k),
t0{x} AS (SELECT query_id, {sql_tokens('raw_q')} AS t FROM {queries}),
t1{x} AS (SELECT query_id, t, list_filter(list_transform(t, lambda x, i: CASE WHEN i > 1 AND {_joins('i')} THEN '' ELSE x || CASE WHEN {_joins('i + 1')} THEN t[i + 1] ELSE '' END END), lambda x: x <> '') AS j,
    flatten(list_transform(t, lambda x: CASE WHEN regexp_full_match(x, '[a-z]{{2,}}[0-9]{{1,2}}') THEN [regexp_extract(x, '^[a-z]+'), regexp_extract(x, '[0-9]+$')] ELSE [x] END)) AS p FROM t0{x} WHERE len(t) > 0),
fo{x} AS (SELECT query_id, 0 AS form, t FROM t1{x} UNION ALL SELECT query_id, 1, j FROM t1{x} WHERE j <> t UNION ALL SELECT query_id, 2, p FROM t1{x} WHERE p <> t AND p <> j),
ru{x} AS (SELECT query_id, form, s.range AS s, n.range AS n, array_to_string(t[s.range + 1:s.range + n.range], ' ') AS phrase FROM fo{x}, range(0, 12) s, range(1, 5) n WHERE s.range + n.range <= len(t)),
ca{x} AS (SELECT r.*, 0 AS turn, r.phrase AS known FROM ru{x} r WHERE phrase IN (SELECT phrase FROM al{x})
    UNION ALL SELECT r.*, 1, o.phrase FROM ru{x} r JOIN (SELECT DISTINCT phrase FROM al{x}) o ON o.phrase = CASE WHEN regexp_full_match(r.phrase, '[a-z]{{2,5}}[0-9]{{1,4}}') THEN regexp_replace(r.phrase, '([a-z]+)([0-9]+)', '\\1 \\2') WHEN regexp_full_match(r.phrase, '[a-z]{{2,5}} [0-9]{{1,4}}') THEN replace(r.phrase, ' ', '') END
    UNION ALL SELECT r.*, 2, o.phrase FROM ru{x} r JOIN de{x} o ON o.k = replace(r.phrase, ' ', '') WHERE n > 1 AND o.phrase <> r.phrase),
be{x} AS (SELECT * FROM ca{x} QUALIFY row_number() OVER (PARTITION BY query_id, form, s ORDER BY turn, n DESC) = 1),
wa{x} AS (SELECT query_id, form, 0 AS at, len(t) AS size FROM fo{x} UNION ALL SELECT w.query_id, w.form, w.at + coalesce(b.n, 1), size FROM wa{x} w LEFT JOIN be{x} b ON b.query_id = w.query_id AND b.form = w.form AND b.s = w.at WHERE w.at < size),
sp{x} AS (SELECT b.*, row_number() OVER (PARTITION BY b.query_id, b.form ORDER BY s) AS j FROM be{x} b JOIN wa{x} w ON b.query_id = w.query_id AND b.form = w.form AND b.s = w.at),
ch{x} AS (SELECT query_id, form, j, 0 AS a, known AS alt FROM sp{x} WHERE turn > 0 UNION ALL SELECT query_id, form, j, a + CASE WHEN turn > 0 THEN 1 ELSE 0 END, alt FROM sp{x} JOIN al{x} ON al{x}.phrase = known),
sz{x} AS (SELECT query_id, form, j, count(*) AS size FROM ch{x} GROUP BY ALL),
su{x} AS (SELECT query_id, form, j, size, coalesce(product(size) OVER (PARTITION BY query_id, form ORDER BY j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)::bigint AS unit, product(size) OVER (PARTITION BY query_id, form)::bigint AS total, count(*) OVER (PARTITION BY query_id, form) AS many FROM sz{x}),
vc{x} AS (SELECT query_id, form, 0 AS ord, 0 AS j, 0 AS a FROM fo{x} UNION ALL SELECT query_id, form, j * 1000 + a, j, a FROM ch{x}
    UNION ALL SELECT query_id, form, 1000000 + c.range, j, (c.range // unit) % size FROM su{x}, range(0, 24) c WHERE many > 1 AND c.range < total),
vo{x} AS (SELECT DISTINCT query_id, form, ord FROM vc{x}),
pi{x} AS (SELECT vo{x}.query_id, vo{x}.form, ord, i.range AS s, t[i.range + 1] AS piece FROM vo{x} JOIN fo{x} USING (query_id, form), range(0, 12) i WHERE i.range < len(t) AND NOT EXISTS (SELECT 1 FROM sp{x} z WHERE z.query_id = vo{x}.query_id AND z.form = vo{x}.form AND z.s <= i.range AND i.range < z.s + z.n)
    UNION ALL SELECT v.query_id, v.form, v.ord, z.s, coalesce(h.alt, z.phrase) FROM vo{x} v JOIN sp{x} z ON z.query_id = v.query_id AND z.form = v.form LEFT JOIN vc{x} c ON c.query_id = v.query_id AND c.form = v.form AND c.ord = v.ord AND c.j = z.j LEFT JOIN ch{x} h ON h.query_id = z.query_id AND h.form = z.form AND h.j = z.j AND h.a = c.a),
tx{x} AS (SELECT query_id, form, ord, string_agg(piece, ' ' ORDER BY s) AS variant FROM pi{x} GROUP BY ALL),
t2{x} AS (SELECT query_id, form, variant, min(ord) AS ord FROM tx{x} GROUP BY query_id, form, variant QUALIFY row_number() OVER (PARTITION BY query_id, form ORDER BY min(ord)) <= 6),
va{x} AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY min((form, ord))) - 1 AS int) AS seq, variant FROM t2{x} GROUP BY query_id, variant QUALIFY seq < 6)"""


#: The variants' hits, each query's own first: vh(query_id, product_id, coverage, tm, sm, name_all, score, seq).
_VARIED = f"""{variants_sql('queries_v')},
vq AS (SELECT query_id * 6 + seq AS query_id, query_id AS own, seq, variant AS raw_q FROM va),
{_PROFILE.replace('queries_v', 'vq')}, {_POSTINGS},
sh AS (SELECT DISTINCT query_id FROM prof WHERE length(token) < 3 AND NOT generic),
{_hits("CASE WHEN query_id % 6 = 0 THEN true WHEN query_id IN (SELECT query_id FROM sh) THEN level = 1 ELSE level > 0 END")},
k5 AS (SELECT * REPLACE (CASE WHEN query_id % 6 > 0 AND query_id IN (SELECT query_id FROM sh) THEN CASE WHEN phrase THEN 15.0::double ELSE 10.0::double END ELSE score END AS score) FROM k WHERE held = needed),
vh AS (SELECT query_id // 6 AS query_id, product_id, coverage, title_hits > 0 AS tm, field_hits > 0 AS sm, name_hits >= needed AS name_all, score,
    CASE WHEN query_id % 6 = 0 THEN 0 WHEN query_id IN (SELECT query_id FROM sh) THEN 7 + query_id % 6 ELSE 1 + query_id % 6 END * 100000 + row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) AS seq FROM k5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) <= 20)"""
_PLATFORM_ROWS = ", ".join(f"({i}, '{k}', '{s}')" for i, (k, names) in enumerate(PLATFORMS.items()) for s in names)
_CONDITION_ROWS = ", ".join(f"('{t}', '{c}')" for c, some in CONDITIONS.items() for t in some)
_LIST = "coalesce(list_sort(list_distinct(list({0}) FILTER (WHERE {1}))), [])"


def _walk(name: str, found: str, words: str) -> str:
    """CTEs ending in ``name``(query_id, seq, s, n): of the runs ``found`` (query_id, seq, s, n) those taken from the left, the longest first."""
    return f"""{name}b AS (SELECT query_id, seq, s, max(n) AS n FROM {found} GROUP BY ALL),
{name}w AS (SELECT query_id, seq, 0 AS pos, len(w) AS size FROM {words} UNION ALL SELECT x.query_id, x.seq, x.pos + coalesce(b.n, 1), size FROM {name}w x LEFT JOIN {name}b b ON b.query_id = x.query_id AND b.seq = x.seq AND b.s = x.pos WHERE x.pos < size),
{name} AS (SELECT b.* FROM {name}b b JOIN {name}w x ON b.query_id = x.query_id AND b.seq = x.seq AND b.s = x.pos)"""


#: What queries name: rec(query_id, brands, typed, ambiguous, platforms, rest, condition), as lists.
_NAMED = f"""{variants_sql('queries_v')}, {_PROFILE},
gw AS (SELECT token FROM df, n WHERE NOT regexp_matches(token, '^[0-9]+$') AND df / n > {RATIO}),
pl AS (SELECT term, arg_min(key, pos) AS key FROM (SELECT pos, key, phrase AS term FROM (VALUES {_PLATFORM_ROWS}) AS v(pos, key, phrase) UNION ALL SELECT pos, key, alt FROM (VALUES {_PLATFORM_ROWS}) AS v(pos, key, phrase) JOIN al USING (phrase)) GROUP BY term),
br AS (SELECT DISTINCT array_to_string({sql_tokens('brand')}, ' ') AS brand, false AS amb FROM products_v UNION ALL SELECT unnest({list(AMBIGUOUS)}), true),
nm AS (SELECT brand AS phrase, brand, amb, NULL::varchar AS key FROM br UNION ALL SELECT al.phrase, brand, amb, NULL::varchar FROM br JOIN al ON al.alt = brand UNION ALL SELECT term, NULL::varchar, false, key FROM pl),
vw AS (SELECT query_id, seq, string_split(variant, ' ') AS w, variant FROM va),
vr AS (SELECT query_id, seq, variant, s.range AS s, n.range AS n, array_to_string(w[s.range + 1:s.range + n.range], ' ') AS phrase FROM vw, range(0, 12) s, range(1, 4) n WHERE s.range + n.range <= len(w)),
vf AS (SELECT vr.*, brand, amb, key FROM vr JOIN nm USING (phrase) WHERE brand IS NULL OR NOT amb OR phrase = variant),
{_walk('vp', 'vf', 'vw')},
vn AS (SELECT vf.*, seq = 0 AND (brand = phrase OR NOT (phrase IN (SELECT term FROM pl) OR NOT EXISTS (SELECT 1 FROM unnest(string_split(phrase, ' ')) AS u(x) WHERE x NOT IN (SELECT token FROM gw)))) AS typed FROM vf JOIN vp USING (query_id, seq, s, n)),
ns AS (SELECT query_id, {_LIST.format('brand', 'brand IS NOT NULL')} AS brands, {_LIST.format('brand', 'typed AND brand IS NOT NULL')} AS typed, {_LIST.format('brand', 'amb')} AS ambiguous, {_LIST.format('key', 'key IS NOT NULL')} AS platforms, min(seq) AS first FROM vn GROUP BY query_id),
cw AS (SELECT vr.*, condition FROM vr JOIN (VALUES {_CONDITION_ROWS}) AS v(phrase, condition) USING (phrase) WHERE seq = 0 AND n <= 2),
{_walk('cp', 'cw', '(SELECT * FROM vw WHERE seq = 0)')},
cn AS (SELECT query_id, CASE WHEN bool_or(condition = 'used') THEN 'used' ELSE 'new' END AS condition, flatten(list(string_split(phrase, ' '))) AS said FROM cw JOIN cp USING (query_id, seq, s, n) GROUP BY query_id),
rs AS (SELECT query_id, list(x ORDER BY i) AS rest FROM (SELECT v.query_id, v.seq, i.range AS i, w[i.range + 1] AS x FROM vw v JOIN ns ON ns.query_id = v.query_id AND ns.first = v.seq, range(0, 12) i WHERE i.range < len(w)) y
    LEFT JOIN cn USING (query_id) WHERE NOT coalesce(list_contains(said, x), false) AND NOT EXISTS (SELECT 1 FROM vp p WHERE p.query_id = y.query_id AND p.seq = y.seq AND p.s <= i AND i < p.s + p.n) GROUP BY query_id),
rec AS (SELECT v.query_id, coalesce(brands, []) AS brands, coalesce(typed, []) AS typed, coalesce(ambiguous, []) AS ambiguous, coalesce(platforms, []) AS platforms, coalesce(rest, []) AS rest, condition
    FROM (SELECT * FROM vw WHERE seq = 0) v LEFT JOIN ns USING (query_id) LEFT JOIN rs USING (query_id) LEFT JOIN cn USING (query_id))"""
_FACTS = f"""fa AS (SELECT product_id, array_to_string({sql_tokens('brand')}, ' ') AS own, list_concat(list_concat({sql_tokens('title')}, {sql_tokens('tags')}), {sql_tokens('category')}) AS w, {sql_tokens('brand')} AS bw, contains(' ' || array_to_string({sql_tokens('title')}, ' ') || ' ', ' {USED[0]} ') AS used FROM products_v),
fp AS (SELECT fa.product_id, list_distinct(list(key)) AS own_platforms FROM fa JOIN pl ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || term || ' ') GROUP BY fa.product_id),
fs AS (SELECT fa.*, ' ' || array_to_string(w, ' ') || ' ' AS named, list_concat(w, bw) AS words, coalesce(own_platforms, []) AS own_platforms FROM fa LEFT JOIN fp USING (product_id))"""
#: Statuses of the candidates cand(query_id, product_id): st(query_id, product_id, brand, platform, condition, brand_active, platform_active, carried, mentioned).
_STATUSES = """s0 AS (SELECT query_id, product_id, rec.condition AS asked, rest, words, used, own, brands, platforms, own_platforms, list_filter(brands, lambda b: b = own) AS carried, list_filter(brands, lambda b: contains(named, ' ' || b || ' ')) AS mentioned FROM cand JOIN rec USING (query_id) JOIN fs USING (product_id)),
s1 AS (SELECT *, CASE WHEN len(brands) = 0 OR own = '' THEN 0 WHEN len(carried) > 0 THEN 1 WHEN len(mentioned) > 0 THEN 0 ELSE -1 END AS brand, CASE WHEN len(platforms) = 0 OR len(own_platforms) = 0 THEN 0 WHEN list_has_any(own_platforms, platforms) THEN 1 ELSE -1 END AS platform,
    CASE WHEN coalesce(asked, '') = 'used' THEN CASE WHEN used THEN 1 ELSE -1 END WHEN used THEN -1 ELSE 0 END AS condition, len(list_filter(rest, lambda t: len(list_filter(words, lambda x: starts_with(x, t))) = 0)) = 0 AS holds FROM s0),
st AS (SELECT query_id, product_id, brand, platform, condition, bool_or(brand = 1 AND holds) OVER (PARTITION BY query_id) AS brand_active, bool_or(platform = 1 AND holds) OVER (PARTITION BY query_id) AS platform_active, carried, mentioned FROM s1)"""
_ENTITIES = f"{_NAMED}, {_FACTS}, {_POSTINGS}, {_hits(whole=3)}, cand AS (SELECT query_id, product_id FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) <= 50), {_STATUSES}"
_FA, _EN = T.layout(T.KEYS), T.layout({fa: en for en, fa in T.KEYS.items()})
_quoted = lambda pair: ", ".join("'" + x.replace("'", "''") + "'" for x in pair)
_fold = lambda x: sql_normalize(f"translate({x}, '{''.join(T.LETTERS)}', '{''.join(T.LETTERS.values())}')")
#: Rewritings of typos_v that are accepted: acc(query_id, step, rewritten, full_hits).
_RECOVER = f"""{_DICT},
ty AS (SELECT query_id, {_fold('raw_q')} AS q, {_fold(f'translate(raw_q, {_quoted(_FA)})')} AS fa, {_fold(f'translate(raw_q, {_quoted(_EN)})')} AS en FROM typos_v),
rt AS (SELECT query_id, 6 AS step, q AS text FROM ty UNION ALL SELECT query_id, 2, fa FROM ty WHERE fa <> q UNION ALL SELECT query_id, 4, en FROM ty WHERE en <> q),
tk AS (SELECT query_id, step, text, i.range AS i, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')[i.range + 1] AS token FROM rt, range(0, 8) i WHERE i.range < len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'))),
u0 AS (SELECT DISTINCT token FROM tk), {CORRECTED},
sg AS (SELECT query_id, step, text, string_agg(coalesce(correction, token), ' ' ORDER BY i) AS better, count(correction) AS n FROM tk LEFT JOIN corrected USING (token) GROUP BY ALL),
gt AS (SELECT unnest([{', '.join(f"'{t}'" for g in GROUPS for t in g)}]) AS term),
tried AS (SELECT query_id, step, text AS rewritten FROM rt WHERE step < 6
    UNION ALL SELECT query_id, CASE step WHEN 6 THEN 6 ELSE step + 1 END, better FROM sg WHERE n > 0 AND better <> text AND len(list_filter(range(0, 10), lambda x: len(string_split(text, x::varchar)) > len(string_split(better, x::varchar)))) = 0
    UNION ALL SELECT query_id, 1, min(term) FROM ty JOIN gt ON replace(term, ' ', '') = regexp_replace(q, '{_NOTWORD}', '', 'g') WHERE q <> term GROUP BY query_id),
bq AS (SELECT query_id * 8 + step AS query_id, rewritten AS raw_q FROM tried UNION ALL SELECT query_id * 8, raw_q FROM typos_v),
{_PROFILE.replace('queries_v', 'bq')}, {_POSTINGS}, {_hits()},
tp AS (SELECT query_id, name_hits >= needed AS name_all FROM k WHERE held = needed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) <= 20),
fc AS (SELECT query_id, count(*) AS full_hits, bool_or(name_all) AS named FROM tp GROUP BY query_id),
acc AS (SELECT t.query_id, t.step, rewritten, f.full_hits FROM tried t JOIN fc f ON f.query_id = t.query_id * 8 + t.step LEFT JOIN fc o ON o.query_id = t.query_id * 8 WHERE f.full_hits > coalesce(o.full_hits, 0) AND (f.named OR t.step IN (1, 6)))"""
#: Strict hits blended with neighbours, with the entities' factor: j(…, kw, sem, factor), z(query_id, product_id, solid, score).
_LIFTED = f"""{_NAMED}, {_FACTS}, {_POSTINGS}, {_hits()},
kw0 AS (SELECT query_id, product_id, score, title_hits = needed AS solid FROM k WHERE held = needed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER}) <= 1000), {_NEAR},
sem AS (SELECT * FROM nb WHERE product_id IN (SELECT product_id FROM products_v)), cand AS (SELECT query_id, product_id FROM kw0 UNION SELECT query_id, product_id FROM sem), {_STATUSES},
fac AS (SELECT query_id, product_id, brand_active AND brand < 0 AS unsafe, (1 + 0.15 * ((brand_active AND brand > 0)::int + (platform_active AND platform > 0)::int + (condition > 0)::int)) * (1 - 0.10 * ((brand_active AND brand < 0)::int + (platform_active AND platform < 0)::int + (condition < 0)::int))::double AS factor FROM st),
kws AS (SELECT query_id, product_id, score, solid AND NOT coalesce(unsafe, false) AS solid FROM kw0 LEFT JOIN fac USING (query_id, product_id)),
""" + _BLEND_OF.replace("r AS (SELECT query_id, product_id, solid, 0.4", "r AS (SELECT query_id, product_id, solid, score AS hit_score, cosine, CASE WHEN ts > 0 THEN greatest(0, coalesce(score, 0)) / ts ELSE 0 END AS kw, CASE WHEN tc > 0 THEN greatest(0, coalesce(cosine, CASE WHEN solid THEN least(0.4, tc) ELSE 0 END)) / tc ELSE 0 END AS sem, 0.4") + ", " + _BOOST_OF.replace("FROM f JOIN products_v", "FROM (SELECT f.*, coalesce(factor, 1) AS factor FROM f LEFT JOIN fac USING (query_id, product_id)) f JOIN products_v").replace("round(relevance * (", "round(factor * relevance * (")
_BEST = "coverage DESC, tm DESC, (sm AND NOT tm) DESC, score DESC, seq"

SQL = {
    "q_variants": with_views(f"WITH RECURSIVE {variants_sql('queries_v')} SELECT query_id, seq, variant FROM va", "products_v", "queries_v"),
    "q_recognized": with_views(f"WITH RECURSIVE {_NAMED} SELECT query_id, " + ", ".join(f"array_to_string({c}, '|') AS {c}" for c in ("brands", "typed", "ambiguous", "platforms", "rest")) + ", condition FROM rec", "products_v", "queries_v"),
    "q_entities": with_views(f"WITH RECURSIVE {_ENTITIES} SELECT query_id, product_id, brand, platform, condition, brand_active, platform_active FROM st", "products_v", "queries_v"),
    "q_brand_evidence": with_views(
        f"WITH RECURSIVE {_ENTITIES}, ev AS (SELECT query_id, list_distinct(flatten(list(carried))) AS c, list_distinct(flatten(list(mentioned))) AS m FROM st GROUP BY query_id), "
        "ea AS (SELECT query_id, typed, ambiguous, unnest(brands) AS brand FROM rec) "
        "SELECT query_id, brand, coalesce(list_contains(c, brand), false) AS carried, coalesce(list_contains(m, brand), false) AS mentioned, list_contains(ambiguous, brand) AS ambiguous, "
        "list_contains(typed, brand) AND c IS NOT NULL AND NOT coalesce(list_contains(c, brand), false) AND NOT coalesce(list_contains(m, brand), false) AS unmatched FROM ea LEFT JOIN ev USING (query_id)", "products_v", "queries_v",
    ),
    "q_recover": with_views(f"""WITH {_RECOVER} SELECT query_id, step, rewritten, full_hits AS "full" FROM acc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY step) = 1""", "products_v", "typos_v"),
    "hyb_entities": with_views(f"WITH RECURSIVE {_LIFTED}, tc AS (SELECT *, sum(CASE WHEN solid THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY score DESC, product_id ROWS UNBOUNDED PRECEDING) AS o FROM z) SELECT query_id, product_id, solid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM tc WHERE solid OR o <= 40", "products_v", "queries_v"),
    "hyb_explained": with_views(
        f"WITH RECURSIVE {_LIFTED} SELECT query_id, product_id, z.score, round(hit_score, 6) AS hit_score, cosine, cosine IS NULL AND solid AND sem > 0 AS assumed, round(0.4 * kw, 6) AS keyword, round(0.6 * sem, 6) AS semantic, CASE WHEN stock > 0 THEN 0.1::double ELSE 0.0::double END AS stock, "
        "round(CASE WHEN top > 0 THEN 0.1 * popularity / top ELSE 0 END, 6)::double AS popularity, CASE WHEN list_has_all(toks, bw) THEN 0.15::double ELSE 0.0::double END AS brand, CASE WHEN list_has_all(toks, cw) THEN 0.1::double ELSE 0.0::double END AS category, "
        "CASE WHEN len(toks) >= 2 AND contains(tw, ' ' || array_to_string(toks, ' ') || ' ') THEN 0.1::double ELSE 0.0::double END AS tag, round(factor, 6)::double AS factor FROM z JOIN j USING (query_id, product_id, solid)", "products_v", "queries_v",
    ),
    "kw_variants": with_views(
        f"WITH RECURSIVE {_VARIED}, one AS (SELECT * FROM vh QUALIFY row_number() OVER (PARTITION BY query_id, product_id ORDER BY {_BEST}) = 1) "
        f"SELECT query_id, product_id, score, tm AS title_match, name_all, row_number() OVER (PARTITION BY query_id ORDER BY {_BEST}, product_id) AS rank FROM one QUALIFY rank <= 20", "products_v", "queries_v",
    ),
}
