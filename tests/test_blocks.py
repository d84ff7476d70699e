"""Top hits by blocks equal those found by scoring everything, and score less."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import blocks as B
from lodestar.operators import retrieve as R
from lodestar.plans.views import view


@pytest.fixture(scope="module")
def catalog(spark, sf):
    big = sf.replace("0.001", "0.01")
    queries = view(spark, big, "queries_v").unionByName(spark.createDataFrame([(9001, ""), (9002, "blue blue gizmo"), (9003, "economy large blue old hot gizmo"), (9004, "1"), (9005, "large red widget no such words")], "query_id int, raw_q string"))
    return view(spark, big, "products_v"), queries


def exhaustive(index, queries, where="true", whole_words=0):
    found = R.levels(R.profile(queries, index.products, index.ratio), index.postings.where(where), whole_words)
    return R.scored(found, queries, index.products)


def rows(df):
    return sorted((r.query_id, r["rank"], r.product_id, r.held, r.score, r.coverage) for r in df.collect())


@pytest.mark.parametrize("bits", [5, 15])
def test_same_hits_as_by_scoring_all(catalog, bits):
    products, queries = catalog
    index = R.Index(products, 0.5, bits)
    every = exhaustive(index, queries).persist()
    for limit in (3, 20):
        assert rows(index.strict(queries, limit)) == rows(R.ranked(every.where("held = needed"), limit))
    assert rows(index.soft_and(queries)) == rows(R.soft_hits(every))
    assert rows(index.any_terms(queries)) == rows(R.ranked(exhaustive(index, queries, whole_words=R.SHORT)))
    assert rows(index.structured(queries)) == rows(R.ranked(exhaustive(index, queries, "level > 0").where("held = needed")))


@pytest.mark.parametrize("bits", [8])
def test_titles_by_blocks(catalog, bits, monkeypatch):
    products, queries = catalog
    index = R.Index(products, 0.5, bits)
    every = exhaustive(index, queries, "level = 1").where("held = needed").withColumn("score", 10.0 + F.when(F.col("phrase"), 5.0).otherwise(0.0))
    pairs, seen, opened = R.levels(index.profile(queries), index.postings.where("level = 1")).count(), [], B.opened
    monkeypatch.setattr(B, "opened", lambda *a: seen.append(opened(*a).count()) or opened(*a))
    for limit in (3, 20):
        assert rows(index.title_only(queries, limit)) == rows(R.ranked(every, limit))
    assert 0 < sum(seen) < 2 * pairs


def test_most_pairs_are_never_scored(catalog, monkeypatch):
    products, queries = catalog
    index, seen = R.Index(products, 0.5, 7), []
    opened = B.opened
    monkeypatch.setattr(B, "opened", lambda *a: seen.append(opened(*a).count()) or opened(*a))
    assert index.strict(queries, 5).count()
    prof = index.profile(queries)
    pairs = R.levels(prof, index.postings).count()
    assert sum(seen) < pairs / 10
    # of the products that hold all words of a query, many are in blocks that are never opened
    blocks = B.intersected(prof, B.block_lists(index.lists(prof), R.level_worth(), 7), index.popularity, R.PHRASE_BONUS)
    whole = opened(blocks, prof, index.lists(prof), 7).count()
    assert sum(seen) < 0.8 * whole


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 10).alias("k"))
    got = sorted((r.n, r.k, r.id) for r in B.numbered(df, "n", F.desc("k"), F.asc("id")).collect())
    assert [g[0] for g in got] == list(range(1000)) and [(-g[1], g[2]) for g in got] == sorted((-g[1], g[2]) for g in got)
    assert B.numbered(df.limit(0), "n", F.asc("id")).count() == 0


def test_bounds_without_the_word_left_out(catalog):
    products, queries = catalog
    index = R.Index(products, 0.5, 5)
    prof, k = index.profile(queries).where("needed > 1"), 3
    lists = index.lists(prof)
    blocks = B.intersected(prof, B.block_lists(lists, R.level_worth(), 5), index.popularity, R.PHRASE_BONUS, True).persist()
    every = exhaustive(index, queries).where("needed > 1 and held = needed - 1").persist()
    # each block's products without just that word, no others
    assert blocks.agg(F.sum("hits")).first()[0] == every.count() > 0
    assert blocks.join(prof.select("query_id", "needed").distinct(), "query_id").where("key.held <> needed - 1").isEmpty()
    assert not blocks.join(prof.select("query_id", F.length("token").alias("n"), F.col("at").alias("omit")), ["query_id", "omit"]).where("n > 3 and key.score > 10.00001").count()
    # a bound is never below a hit's key
    best = every.join(index.products.select("product_id", B.block_of(bits=5).alias("block")), "product_id").groupBy("query_id", "block").agg(F.max(B.rank_key()).alias("own"))
    bound = blocks.groupBy("query_id", "block").agg(F.max("key").alias("key"))
    assert best.join(bound, ["query_id", "block"]).where("own <= key").count() == best.count()
    turns = blocks.withColumn("before", F.coalesce(F.sum("hits").over(Window.partitionBy("query_id").orderBy(F.desc("key"), "block", "omit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert turns.where(F.col("before") < k).count() < blocks.count()
