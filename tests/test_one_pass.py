"""A search with everything that may be tried instead of its queries, in one pass, equals the steps one after another."""

from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import blocks as B
from lodestar.operators import lexicon, search
from lodestar.operators import retrieve as R
from lodestar.operators import variants as A
from lodestar.operators.vector import mock_embedding

TITLES = ("red lamp", "reddish lamp", "blue lamp big", "monitor stand", "monitor arm", "play station 4", "ps4 red pad", "tv set", "set of lamps", "azure widget 7")


def shop(spark):
    rows = [(i, t, TITLES[i % 7].split()[0], "acme" if i % 2 else "zeta", f"kind{i % 3}", t[::-1] + " desk", f"XX-{i}", 100 - i % 13, i % 2) for i, t in enumerate(TITLES * 5)]
    index = R.Index(spark.createDataFrame(rows, "product_id long, title string, tags string, brand string, category string, description string, sku string, popularity long, stock int").withColumn("specs", F.lit("")), 0.9, 4)
    alts = lexicon.kept(A.alternatives(spark.createDataFrame([(0, ["playstation 4", "ps4"]), (1, ["azure", "blue"]), (2, ["tv", "monitor"])], "group long, terms array<string>")), "alternatives")
    queries = spark.createDataFrame(list(enumerate(("red lamp", "monitr", "xx1", "ps 4", "ps4 pad", "azure7", "lamp desk blue", "tv stand", "", "no such", "the red", "ردپ", "redlamp", "mnoitor arm"), 7)), "query_id long, raw_q string")
    return index, alts, queries


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_rewritings_are_searched_with_the_queries(spark, monkeypatch):
    index, alts, queries = shop(spark)
    words = lexicon.spell_dictionary(index.products)
    alias = spark.createDataFrame([(w,) for w in ("playstation", "ps4", "azure", "blue", "tv", "monitor")], "token string")
    shown, found = search.recovered(index, queries, search.found_hits(index, queries, 5, alts, alias), words, 5, alts, alias)
    calls, text_hits, lists = [], search.text_hits, R.asked_lists
    monkeypatch.setattr(search, "text_hits", lambda *a: calls.append("hits") or text_hits(*a))
    monkeypatch.setattr(R, "asked_lists", lambda *a: calls.append("lists") or lists(*a))
    got_shown, got, _ = search.searched(index, queries, words, 5, alts, alias)
    assert sorted(calls) == ["hits", "lists"]
    columns = ("query_id", "product_id", "match_type", "partial", "name_all", "solid", "score", "rank")
    assert rows(got, *columns) == rows(found, *columns) and got.count() > 20
    assert rows(got_shown, "query_id", "did_you_mean", "applied") == rows(shown, "query_id", "did_you_mean", "applied") and got_shown.where("applied").count()


def test_kinds_of_queries_together(spark):
    index, _, queries = shop(spark)
    queries = queries.union(spark.createDataFrame([(30, "blue lamp"), (31, "monitor")], queries.schema))
    prof = index.profile(queries)
    lists, q = index.lists(prof), F.col("query_id")
    kind = F.when(q == 7, B.WHOLE).when(q == 30, B.FIELDS).when(q == 31, B.TITLES).otherwise((q % 3).cast("int"))
    for k in (2, 20):
        mixed = R.ranked(index.mixed(prof.withColumn("kind", kind), lists, queries, k).where("held = needed"), k)
        of = lambda n: prof.where(kind == n)
        apart = [index.best(of(B.WHOLE), lists, queries, k), index.best(of(B.FIELDS), index.lists(of(B.FIELDS), "level > 0"), queries, k), index.titled(of(B.TITLES), queries, k)]
        columns = ("query_id", "product_id", "held", "score", "rank")
        assert rows(mixed, *columns) == sorted(r for a in apart for r in rows(R.ranked(a.where("held = needed"), k), *columns))
    assert {r.kind for r in mixed.collect()} == {B.WHOLE, B.FIELDS, B.TITLES}


def test_known_lists_serve_whole_words(spark):
    index, _, queries = shop(spark)
    known = index.lists(index.profile(queries))
    columns = ("query_id", "product_id", "held", "score", "partial", "rank")
    got = rows(index.any_terms(queries, 10, known), *columns)
    assert got == rows(index.any_terms(queries, 10), *columns) and got
    three = known.where("asked = 'red'").count()
    assert 0 < index.lists(index.profile(queries), whole_words=3, known=known).where("asked = 'red'").count() < three


def test_expressions_are_computed_once_a_row(spark):
    df = spark.createDataFrame([("Model vii of II  x",), (None,)], "t string")
    out = df.select(T.normalize("t").alias("n"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert [r.n for r in out.collect()] == ["model 7 of 2 x", ""]
    vectors = df.select(mock_embedding(F.coalesce("t", F.lit(""))).alias("v"))
    assert vectors._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 2
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in vectors.collect())
