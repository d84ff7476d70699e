import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import audit, catalog, retrieve, rewrite, search, vector
from lodestar.sources import catalog as sources
from lodestar.sources import vectors


def products(spark):
    rows = [
        (1, "Gizmo mini", "red gear tool", "Acme", "Tools", "small thing", "SKU-11", 3, 5), (2, "Gear box", "gear", "Bolt", "Parts", "", "SKU-12", 0, 9),
        (3, "Gizmo gear", "tool", "Acme", "Tools", "", "XX-1", 1, 1), (4, "Lamp", "light", "Zed", "Home", "gizmo lamp", "XX-2", 1, 2),
    ]
    return spark.createDataFrame(rows, "product_id long, title string, tags string, brand string, category string, description string, sku string, stock int, popularity long").withColumn("specs", F.lit(""))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, raw_q string")


def test_keyword_search_sources(spark):
    index = retrieve.Index(products(spark), 0.99)
    intents = spark.createDataFrame([("tool kit", ["Home"], []), ("kit", [], ["gear"])], "term string, categories array<string>, tags array<string>")
    q = asked(spark, "sku-11", "gizmo gear", "gear lamp", "giz mo", "nothing here", "")
    got = {}
    for r in search.keyword_search(index, q, intents).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.product_id, r.match_type))
    assert got[1] == [(1, "sku")] and got[2][0] == (3, "text") and {p for p, _ in got[2]} >= {1, 3}
    assert {m for _, m in got[3]} == {"partial"} and 5 not in got and 6 not in got
    assert [p for p, _ in got[4]][:2] == [3, 1] or [p for p, _ in got[4]][:2] == [1, 3]
    assert search.generic_only(q, index).where("generic_only").count() == 0


def test_intents_resolve_longest_first(spark):
    intents = spark.createDataFrame([("tool kit", ["A"], ["t"]), ("kit", ["B"], []), ("red", ["C", "A"], [])], "term string, categories array<string>, tags array<string>")
    got = {r.query_id: (r.categories, r.tags) for r in search.resolve_intents(asked(spark, "red tool kit kit", "kit", "none"), intents, 2).collect()}
    assert got == {1: (["C", "A"], ["t"]), 2: (["B"], [])}
    assert search.resolve_intents(asked(spark, "x"), intents.limit(0)).count() == 0


def test_suggestions_apply_without_full_hits(spark):
    index = retrieve.Index(products(spark), 0.99)
    words = spark.createDataFrame([("gizmo", 5), ("gear", 5), ("lamp", 3)], "token string, freq long")
    q = asked(spark, "gizom", "lamp")
    shown, found = search.recovered(index, q, search.found_hits(index, q), words)
    assert [(r.query_id, r.did_you_mean, r.applied) for r in shown.collect()] == [(1, "gizmo", True)]
    assert {r.product_id for r in found.where("query_id = 1").collect()} == {1, 3, 4}


def test_hybrid_pins_codes(spark):
    index, q = retrieve.Index(products(spark), 0.99), asked(spark, "sku-11")
    keyword = spark.createDataFrame([(1, 1, "sku", 2e6, 1, False), (1, 3, "text", 5.0, 2, True), (1, 99, "text", 9.0, 3, True)], "query_id long, product_id long, match_type string, score double, rank int, solid boolean")
    near = spark.createDataFrame([(1, 4, 0.9), (1, 98, 0.99)], "query_id long, product_id long, cosine double")
    got = [(r.product_id, r.pinned) for r in search.hybrid_search(index, q, keyword, near).orderBy("rank").collect()]
    assert got[0] == (1, True) and {p for p, _ in got} == {1, 3, 4}


def test_candidates_terms_and_variants(spark):
    index = retrieve.Index(products(spark), 0.99)
    counts = {r.term: r.products for r in retrieve.term_counts(index, spark.createDataFrame([("gear",), ("zzz",)], "term string"), 1).collect()}
    assert counts == {"gear": 2, "zzz": 0}  # 3 products hold it: one more than the most stands for all above
    hits = spark.createDataFrame([(1, i, i % 3, i) for i in range(9)], "query_id int, product_id int, held int, popularity int")
    assert [r.product_id for r in retrieve.capped(hits, 2).orderBy("product_id").collect()] == [5, 8]
    full = spark.createDataFrame([(1, 2, False, True, 10.0), (2, 2, False, True, 8.0), (3, 1, False, True, 50.0)], "query_id int, rank int, partial boolean, title_match boolean, score double")
    assert sorted(r.query_id for r in retrieve.spacing_can_rank(full, 2).collect()) == [2, 3]


def test_rewriting_pieces(spark):
    lists = [spark.createDataFrame([("a",), (" ",)], "name string"), spark.createDataFrame([("a ",), ("b",)], "name string")]
    assert sorted(tuple(r) for r in rewrite.collected_names(lists).collect()) == [("a", 0), ("b", 1)]
    row = spark.range(1).select(T.like_escape(F.lit("5%_\\")).alias("e"), T.rest_of(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("b"))).alias("r")).first()
    assert row.e == "5\\%\\_\\\\" and row.r == ["a", "a"]


def test_vector_pieces(spark):
    v = spark.range(20).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t")).select(vector.mock_embedding(F.col("t"), 16).alias("e")).collect()
    assert all(abs(sum(x * x for x in r.e) - 1) < 1e-9 for r in v) and len({tuple(r.e) for r in v}) == 20
    rows = spark.createDataFrame([(1, 5, 0.9), (1, 6, float("nan")), (1, None, 0.9), (1, 4, 0.9), (1, 7, 0.1)], "query_id int, id int, score double")
    assert [(r.id, r["rank"]) for r in vector.served(rows).orderBy("rank").collect()] == [(4, 1), (5, 2)]
    kw = spark.createDataFrame([(1, 1, 4.0, True)], "query_id long, product_id long, score double, solid boolean")
    near = spark.createDataFrame([(1, 3, 0.9)], "query_id long, product_id long, cosine double")
    q = asked(spark, "acme").select("query_id", F.array(T.tokenize(T.normalize("raw_q"))).alias("variants"))
    parts = {r.product_id: r for r in vector.explained(vector.blend(kw, near), products(spark), q).collect()}
    assert parts[1].brand == 0.15 and parts[1].keyword == 0.4 and parts[1].category == 0


def test_vector_tables(spark, tmp_path):
    path = str(tmp_path / "v")
    good = spark.range(5).select("id", vector.mock_embedding(F.col("id").cast("string"), 8).alias("embedding"))
    vectors.write_vectors(good, path, "m")
    assert vectors.read_vectors(spark, path, "m").count() == 5
    with pytest.raises(ValueError, match="model"):
        vectors.read_vectors(spark, path, "other")
    vectors.write_vectors(good.withColumn("id", F.lit(1)).withColumn("embedding", F.array(F.lit(2.0))), path, "m")
    with pytest.raises(ValueError, match="ids, norm"):
        vectors.read_vectors(spark, path, "m")


def test_csv_and_sql(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([('a "b", c', None), (None, "x")], "p string, q string").coalesce(1).write.parquet(path + "p")
    sources.write_csv(spark.read.parquet(path + "p"), path)
    text = "".join(f.read_text() for f in (tmp_path / "c").glob("part*"))
    assert text.splitlines()[0] == "p,q" and '"a ""b"", c",' in text and "\n,x" in text
    sql = "insert into `t` (`a`, b) values (1, 'C:\\temp'), (NULL, 'it''s; (x)');\nINSERT INTO u (z) VALUES (2.5);"
    assert list(sources.insert_rows(sql)) == [{"a": "1", "b": "C:\\temp"}, {"a": None, "b": "it's; (x)"}, {"z": "2.5"}]
    with pytest.raises(ValueError):
        list(sources.insert_rows("INSERT INTO t (a, b) VALUES (1)"))


def test_audit(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 12, m)
    rows = spark.createDataFrame([(i, at(i), "u", "login_failed" if i < 6 else "login") for i in range(8)], "id long, ts timestamp, who string, action string")
    assert audit.failed_logins(rows, at(7), 5).first().failures == 3
    flags = audit.throttled(rows.withColumn("failed", F.col("action") == "login_failed"), 3, 4).orderBy("id").collect()
    assert [r.throttled for r in flags] == [False, False, False, True, True, True, True, True]
    assert [r.id for r in audit.recent(rows, 2).collect()] == [7, 6] and audit.latest_per_action(rows).count() == 2
    v = audit.version_of(rows)
    assert audit.guarded(rows.orderBy("ts"), v).count() == 8
    with pytest.raises(audit.Stale):
        audit.guarded(rows.limit(7), v)


def test_export_and_pages(spark):
    p = spark.createDataFrame([(1, 10, "a"), (2, 99, "b")], "product_id long, brand int, title string")
    names = spark.createDataFrame([(10, "Acme")], "id int, name string")
    tags = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x")], "pid long, tag string")
    out = catalog.star_export(p, {"brand": (names, "id", "name")}, {"tags": (tags, "pid", "tag", " ")}).orderBy("product_id").collect()
    assert [(r.brand, r.tags) for r in out] == [("Acme", "x y"), ("", "")]
    assert catalog.server_rows(catalog.star_export(p, {}, {})).columns == "product_id title description normalized_title normalized_desc normalized_specs normalized_tags normalized_brand normalized_category normalized_collapsed tags brand category model sku normalized_sku price stock url image popularity".split()
    rows = spark.createDataFrame([(i // 3, i) for i in range(10)], "a int, b int")
    page, seen = None, []
    while got := catalog.page_after(rows, ["a", "b"], page, 4).collect():
        seen += [r.b for r in got]
        page = [got[-1].a, got[-1].b]
    assert seen == list(range(10)) and catalog.bounded_count(rows, 3) == 3
    cut = spark.createDataFrame([("one two\\nthree",), ("abcdefghij",)], "d string").select(T.index_description("d", 9).alias("x")).collect()
    assert [r.x for r in cut] == ["one", ""] or [r.x for r in cut] == ["one", ""]


def test_export_opens_the_files_that_a_page_needs(spark):
    from lodestar.operators import paging

    logs = spark.range(1, 1001).select("id", F.concat(F.lit("q"), F.col("id") % 7).alias("raw_q"), (F.col("id") % 5).alias("result_count"), F.lit("secret").alias("ip"))
    pages = paging.clustered(logs, 100)
    files = pages.files.orderBy(F.desc("newest")).collect()
    assert len(files) == 10 and all(a.oldest > b.newest for a, b in zip(files, files[1:]))
    opened, of = [], paging.Pages._of
    paging.Pages._of = lambda self, rows, names: opened.append(len(names)) or of(self, rows, names)
    try:
        first = pages.page(None, 40)
        assert [r.id for r in first.orderBy(F.desc("id")).collect()] == list(range(1000, 960, -1)) and opened == [1] and first.columns == ["id", "raw_q", "result_count"]
        seen, last = [], None
        while got := [r.id for r in pages.page(last, 150, F.col("result_count") == 0).orderBy(F.desc("id")).collect()]:
            seen, last = seen + got, got[-1]
        assert seen == list(range(1000, 0, -5))
        opened.clear()
        assert pages.page(101, 500).count() == 100 and opened[0] == 1 and max(opened) <= 2
    finally:
        paging.Pages._of = of
    placed = pages.export(250, F.col("result_count") > 0, 100).collect()
    assert sorted(r.place for r in placed) == list(range(250)) and {r.page for r in placed} == {0, 1, 2} and max(r.id for r in placed) == 999
