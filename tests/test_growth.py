"""Steps whose work must not grow faster than the tables, and whose results equal the plain forms."""

import datetime as dt
import inspect
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import evaluate as E
from lodestar.operators import logs as L
from lodestar.operators import retrieve as R
from lodestar.operators import vector as V
from lodestar.operators.lexicon import spell_dictionary
from lodestar.plans import reports
from lodestar.plans.views import view


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lookups_of_a_week_by_running_sums(spark):
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    data = [(i, rng.choice(["a", "b", None]), start + dt.timedelta(seconds=rng.randrange(40) * 43200) if i % 17 else None, i % 5 == 0) for i in range(400)]
    got = L.cache_lifetime(spark.createDataFrame(data, "id long, key string, ts timestamp, empty boolean"), hot=20)
    assert "-604800" not in plan(got)  # such a frame is added up anew for every row
    week = dt.timedelta(days=7)
    seen = lambda k, t: sum(1 for _, key, at, _ in data if key == k and ((at is None and t is None) or (at is not None and t is not None and t - week <= at <= t)))
    expected = {i: (seen(k, t), 300 if e else 604800 if seen(k, t) >= 20 else 86400) for i, k, t, e in data}
    assert {r.id: (r.lookups, r.ttl) for r in got.collect()} == expected and got.columns == ["id", "key", "ts", "empty", "lookups", "ttl"]


def test_tiles_of_scores_with_ties(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, (40, 4)).astype(float)
    vectors = np.concatenate([base, base, base, np.zeros((2, 4)), rng.normal(size=(60, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    asked = df.where("id % 7 = 0").select(F.col("id").alias("query_id"), "embedding")
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    u = vectors / np.where(norms == 0, 1, norms)
    expected = []
    for q in range(0, len(u), 7):
        s = np.round(u @ u[q], 6)
        expected += [(q, int(i), r + 1) for r, i in enumerate([i for i in np.lexsort((np.arange(len(u)), -s)) if s[i] >= 0.2][:5])]
    plans = set()
    for tile in ((256, 8192), (3, 7), (1, 2)):
        out = V.top_k(asked, df, 5, 0.2, tile)
        assert sorted((r.query_id, r.id, r["rank"]) for r in out.collect()) == sorted(expected)
        plans.add(re.sub(r"#\d+L?", "", plan(out)))
    assert len(plans) == 1  # small tiles don't copy the vectors


def test_codes_meet_by_equality(spark):
    codes = ["AB-12", "ab12", "AB-123", "abcd", "abcde", "1", "12345", "1234", "x", "", None]
    products = spark.createDataFrame([(i, c, i % 3, "t", "g", "b") for i, c in enumerate(codes)], "product_id long, sku string, popularity long, title string, tags string, brand string")
    queries = spark.createDataFrame(list(enumerate(["ab-12", "AB12", "abcd", "123", "1234", "1", "", "ab-1", "12345678"])), "query_id long, raw_q string")
    out = R.Index(products).sku(queries)
    assert "StartsWith" not in plan(out)  # many codes have their first characters in common
    clean = lambda c: "".join(x for x in (c or "").lower() if x.isalnum())
    expected = set()
    for q, raw in [(r.query_id, r.raw_q) for r in queries.collect()]:
        c = clean(raw)
        expected |= {(q, i, clean(s) == c) for i, s in enumerate(codes) if c and s and (clean(s) == c or (len(c) >= 4 and any(x.isdigit() for x in c) and clean(s).startswith(c)))}
    assert {(r.query_id, r.product_id, r.score == R.SKU_EXACT) for r in out.collect()} == expected


def test_other_spacing_meets_by_equality(spark):
    names = [("big red ring", "red ring"), ("bigred ring", "x"), ("big redring", "rings"), ("redringing", "big")]
    products = spark.createDataFrame([(i, t, g, "b", i, "s") for i, (t, g) in enumerate(names)], "product_id long, title string, tags string, brand string, popularity long, sku string")
    queries = spark.createDataFrame([(1, "red ring"), (2, "redring"), (3, "big red"), (4, "ringing"), (5, "bigredring")], "query_id long, raw_q string")
    index = R.Index(products)
    out = index.collapsed(queries)
    assert "StartsWith" not in plan(out)
    got = {(r.query_id, r.product_id) for r in out.collect()}
    assert got == {(1, 0), (1, 2), (1, 3), (2, 0), (3, 0), (3, 1), (3, 2), (5, 0), (5, 1), (5, 2)}


def test_judgements_without_lists(spark):
    titles = spark.createDataFrame([(i, sorted({["red", "blue"][i % 2], "ring", str(i % 5)})) for i in range(60)], "product_id long, held array<string>")
    queries = spark.createDataFrame([(1, ["red", "ring"]), (2, ["ring", "3"]), (3, ["ring", "ring"]), (4, []), (5, ["none", "red"]), (6, ["7"])], "query_id int, words array<string>")
    pairs = E.titles_holding(queries, titles)
    got = {(r.query_id, r.product_id) for r in pairs.collect()}
    assert got == {(1, i) for i in range(0, 60, 2)} | {(2, i) for i in range(3, 60, 5)}
    results = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (1, 4, 8), (2, 1, 3), (6, 1, 1)], "query_id int, rank int, product_id long")
    lists = queries.select("query_id").join(pairs, "query_id", "left").groupBy("query_id").agg(F.collect_set("product_id").alias("relevant"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(E.per_query_of_pairs(results, queries, pairs, 3)) == rows(E.per_query(results, lists, 3))
    assert "collect_set" not in inspect.getsource(E.per_query_of_pairs)


def test_fields_are_normalized_once(spark):
    products = spark.createDataFrame([(1, "Red ring red", "ring blue", "red", None, "x: 9", "blue green 9 ring")], "product_id long, title string, tags string, brand string, category string, specs string, description string")
    out = R.postings(products)
    assert {(r.token, r.level) for r in out.collect()} == {("red", 1), ("ring", 1), ("blue", 2), ("x", 5), ("9", 5), ("green", 0)}
    one = plan(products.select(R.tokenize(R.normalize("title")))).count("regexp_replace")
    assert plan(out).count("regexp_replace") <= 6 * one


def test_pages_read_a_stored_log(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(reports, "log_page", lambda logs, *a, **kw: seen.append(plan(logs)) or logs.withColumn("place", F.lit(1)))
    reports.QUERIES["log_pages"](spark, sf)
    assert len(seen) == len(reports.PAGES) and not any("Join" in p for p in seen)


def test_words_are_counted_from_the_postings(spark, sf):
    index = R.Index(view(spark, sf, "products_v"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.frequencies) == rows(R.token_df(index.products)) and index.frequencies.count()
    assert rows(index.dictionary) == rows(spell_dictionary(index.products))
    assert {"words", "postings"} <= index.__dict__.keys()


def test_postings_stay_where_they_are(spark, sf):
    index = R.Index(view(spark, sf, "products_v"))
    asked = index.profile(view(spark, sf, "queries_v"))
    lists = R.asked_lists(asked, index.postings, words=index.words)
    text = lists._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text  # few words are asked for
    key = lambda df: sorted(map(tuple, df.select("asked", "product_id", "level").collect()))
    assert key(lists) == key(R.asked_lists(asked, index.postings)) and lists.count()


def test_each_distinct_name_is_met_once(spark):
    products = spark.createDataFrame([(i, "big red ring", "red ring", "b", i, "s") for i in range(200)], "product_id long, title string, tags string, brand string, popularity long, sku string")
    seen, kept = [], R.kept
    R.kept = lambda df, name: seen.append((name, kept(df, name))) or seen[-1][1]
    try:
        out = R.Index(products).collapsed(spark.createDataFrame([(1, "redring"), (2, "bigred")], "query_id long, raw_q string"), 500)
        assert out.where("query_id = 1").count() == 200 and out.where("query_id = 2").count() == 200
    finally:
        R.kept = kept
    assert [df.count() for name, df in seen if name == "spaced-names"] == [3]
