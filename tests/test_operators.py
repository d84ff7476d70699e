import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.operators import analytics, calls, evaluate, insights, lexicon, lifecycle, logs, retrieve, rewrite, vector
from lodestar.sources import catalog
from lodestar.streaming import state

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def log_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, session_id string, normalized_q string, raw_q string, page int, result_count long")


def test_incidents_split_after_a_minute(spark):
    rows = [(i, at(s), "probe", "timeout", 5) for i, s in enumerate((0, 59, 119, 180))]
    got = calls.incidents(spark.createDataFrame(rows, "id long, ts timestamp_ntz, kind string, outcome string, duration_ms long")).orderBy("start").collect()
    assert [(r.start, r.n) for r in got] == [(at(0), 3), (at(180), 1)]


def test_duplicates_and_bursts(spark):
    rows = log_rows(spark, [(i, at(s), sid, "q", "q", 1, 1) for i, (s, sid) in enumerate([(0, "a"), (120, "a"), (241, "a"), (0, None), (10, None), (20, None), (60, None)])])
    assert [r.id for r in logs.flag_duplicates(rows).where("is_duplicate").orderBy("id").collect()] == [1]
    assert [r.id for r in logs.flag_bursts(rows).where("is_burst").orderBy("id").collect()] == [6]


def test_stream_flags_equal_batch(spark, tmp_path):
    rows = log_rows(spark, [(i, at(i * 37 % 400), ["a", None, "b"][i % 3], "q", "q", 1, i % 2) for i in range(60)]).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for flag, batch, streamed in (("is_duplicate", logs.flag_duplicates, state.flag_duplicates), ("is_burst", logs.flag_bursts, state.flag_bursts)):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = streamed(stream).writeStream.format("memory").queryName(flag).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {(r.id, r[flag]) for r in spark.table(flag).collect()} == {(r.id, r[flag]) for r in batch(rows).collect()}


def test_stream_windows_drop_late_rows(spark, tmp_path):
    schema = "id long, ts timestamp, result_count long"
    for i, batch in enumerate(([(1, at(10), 0), (2, at(7300), 1)], [(5, at(9000), 1)], [(3, at(20), 1), (4, at(20000), 1)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = state.counts(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").where(F.col("start") == F.lit(T0)).select("n").collect()[0].n == 1


def test_missing_columns_drop_their_condition(spark):
    rows = spark.createDataFrame([(1, 1, "page"), (2, 2, "page"), (3, 1, "filter")], "id long, page int, source string")
    assert [r.id for r in logs.searches(rows).collect()] == [1]
    assert [r.id for r in logs.searches(rows.drop("source")).orderBy("id").collect()] == [1, 3]
    df, present = logs.with_defaults(rows, {"is_burst": ("boolean", False), "page": ("int", 9)})
    assert present == {"id", "page", "source"} and df.first().is_burst is False and df.first().page == 1


def test_percentile_is_a_value(spark):
    rows = log_rows(spark, [(i, at(i), "a", "q", "q", 1, 1) for i in range(1, 5)]).withColumn("latency_ms", F.col("id") * 10)
    row = analytics.latency(rows).first()
    assert (row.n, row.p50, row.p95, row.max_ms) == (4, 20.0, 40.0, 40)
    empty = analytics.result_health(rows.limit(0)).first()
    assert (empty.searches, empty.zero_pct, empty.avg_results) == (0, 0.0, 0.0)


def test_follow_up_is_the_first_other_query_with_results(spark):
    rows = log_rows(spark, [(1, at(0), "s", "a", "a", 1, 0), (2, at(20), "s", "a", "a", 1, 3), (3, at(60), "s", "b", "b", 1, 2), (4, at(61), "s", "c", "c", 1, 2), (5, at(5), "t", "b", "b", 1, 2)])
    rows = rows.withColumns({"log_version": F.lit(2), "is_suspicious": F.lit(False), "source": F.lit("page"), "search_uuid": F.col("id").cast("string")})
    assert [(r.id, r.next_id) for r in insights.follow_ups(rows).collect()] == [(1, 3)]


def test_strict_search_levels_and_ties(spark):
    rows = [(1, "red ring", "", "", "", "", "blue"), (2, "blue ring", "", "", "", "", "red"), (3, "ringer red", "", "", "", "", ""), (4, "plate", "red ring", "", "", "", ""), (5, "ring", "", "", "", "", "")]
    products = spark.createDataFrame(rows, "product_id long, title string, tags string, brand string, category string, specs string, description string").withColumns({"sku": F.lit("X"), "popularity": F.lit(0)})
    index = retrieve.Index(products, 0.99)
    got = index.strict(spark.createDataFrame([(1, "red ring")], "query_id long, raw_q string")).orderBy("rank").collect()
    assert [r.product_id for r in got] == [1, 3, 2, 4]
    assert got[0].phrase and not got[1].phrase and got[0].score == pytest.approx(15)


def test_sku_and_collapsed(spark):
    products = spark.createDataFrame([(1, "Far Cry 5", "AB-1234"), (2, "Farcry", "ab123"), (3, "Cry", "zz")], "product_id long, title string, sku string").withColumns({c: F.lit("") for c in ("tags", "brand", "category", "specs", "description")}).withColumn("popularity", F.lit(0))
    index = retrieve.Index(products)
    q = spark.createDataFrame([(1, "ab 123"), (2, "far cry"), (3, "farcry")], "query_id long, raw_q string")
    assert [(r.query_id, r.product_id, r.score) for r in index.sku(q).orderBy("query_id", "rank").collect()] == [(1, 2, 2e6), (1, 1, 1e6)]
    assert {(r.query_id, r.product_id) for r in index.collapsed(q).where("query_id > 1").collect()} == {(2, 1), (2, 2), (3, 1)}


def test_spelling(spark):
    words = {"battle": 5, "controller": 9, "monitor": 4, "moniter": 1, "kala": 50}
    dictionary = spark.createDataFrame(list(words.items()), "token string, freq long")
    asked = ["battel", "controler", "kontroller", "monitar", "kalaf", "battle", "abc", "monitar2"]
    got = {r.token: r.correction for r in rewrite.corrections(spark.createDataFrame([(t,) for t in asked], "token string"), dictionary).collect()}
    assert got == {"battel": "battle", "controler": "controller", "kontroller": "controller", "monitar": "monitor", "monitar2": "monitor2"}


def test_longest_phrases_dont_overlap(spark):
    q = spark.createDataFrame([(1, "sony play station 4")], "query_id long, raw_q string")
    known = spark.createDataFrame([("play station",), ("station 4",), ("sony",), ("play",)], "phrase string")
    assert {r.phrase for r in rewrite.phrases_in(q, known).collect()} == {"sony", "play station"}


def test_blend_keeps_solid_hits_and_caps_the_tail(spark):
    kw = spark.createDataFrame([(1, 1, 10.0, True), (1, 2, 1.0, True), (1, 3, 1.0, False)], "query_id long, product_id long, score double, solid boolean")
    sem = spark.createDataFrame([(1, 4, 0.8), (1, 5, 0.1)], "query_id long, product_id long, cosine double")
    got = {r.product_id: r for r in vector.blend(kw, sem).collect()}
    assert set(got) == {1, 2, 4} and got[1].relevance == pytest.approx(0.4 + 0.6 * 0.5) and got[4].relevance == pytest.approx(0.6)
    rows = spark.createDataFrame([(1, i, i == 9, 1.0) for i in range(10)], "query_id long, product_id long, solid boolean, score double")
    assert [r.product_id for r in vector.tail_capped(rows, 3).orderBy("rank").collect()] == [0, 1, 2, 9]


def test_negative_queries_count(spark):
    results = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (3, 1, 9)], "query_id long, rank int, product_id long")
    judged = spark.createDataFrame([(1, [6]), (2, []), (3, [])], "query_id long, relevant array<bigint>")
    got = {r.query_id: r for r in evaluate.per_query(results, judged, 2).collect()}
    assert (got[1].first_rank, got[1].recall, got[1].precision) == (2, 1.0, 0.5) and got[2].recall == 1 and got[3].recall == 0


def test_components_reach_far(spark):
    pairs = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z1", "z2")], "a string, b string")
    got = {r.node: r.label for r in lexicon.groups_of(pairs).collect()}
    assert set(got.values()) == {"n000", "z1"} and len(got) == 43


def test_sources(spark, tmp_path):
    sql = "INSERT INTO p VALUES (1,'it''s (a), b',NULL),\n(2, 'x;y', 3.5); INSERT INTO p (c, b, a) VALUES ('','é',3);"
    rows = [[r[c] for c in "abc"] for r in catalog.insert_rows(sql, ["a", "b", "c"])]
    assert rows == [["1", "it's (a), b", None], ["2", "x;y", "3.5"], ["3", "é", ""]]
    (tmp_path / "p.sql").write_text(sql)
    assert sorted(r.b for r in catalog.read_inserts(spark, str(tmp_path / "p.sql"), ["a", "b", "c"]).collect()) == ["it's (a), b", "x;y", "é"]
    (tmp_path / "d.txt").write_text("a\t3\nbad\nb\tx\n")
    assert [tuple(r) for r in catalog.read_dictionary(spark, str(tmp_path / "d.txt")).collect()] == [("a", 3)]
    (tmp_path / "g.csv").write_text("# note\nquery,relevant_ids,note\nx,3;4;3,\n ,1,\ny,,off\n")
    got = {r.query: r.relevant for r in catalog.read_golden(spark, str(tmp_path / "g.csv")).collect()}
    assert got == {"x": [3, 4], "y": []}
    (tmp_path / "q.csv").write_text('id;name\n1;"a\nb"\n2;c\n')
    assert [r.name for r in catalog.read_csv(spark, str(tmp_path / "q.csv")).collect()] == ["a\nb", "c"]


def test_bundles(spark, tmp_path):
    b = lifecycle.Bundles(str(tmp_path))
    for v, n in (("1", 3), ("2", 4)):
        b.write(v, {"products": spark.range(n)}, {"count": 3})
        b.switch(v)
    assert b.current == "2" and b.problems(spark, "1") == [] and b.problems(spark, "2") == ["count"]
    b.rollback()
    assert b.current == "1"
    with b.lock(), pytest.raises(RuntimeError, match="busy"), b.lock():
        pass


def test_spreadsheet_export(spark):
    rows = spark.createDataFrame([(1, "=x"), (2, "x"), (3, None)], "id long, error string")
    assert [r.error for r in calls.safe_export(rows).orderBy("id").collect()] == ["'=x", "x", None]
