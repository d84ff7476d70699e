import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ann, langid, quality
from lodestar.llm.registry import QUERIES


def test_nearest_recall_and_ties(spark, table):
    r = np.random.RandomState(0)
    v = r.randn(6000, 16)
    v[100:130] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] + [1.0] * 15), (9150, []), (9200, [1.0, None]), (None, v[0].tolist()), (9250, [1.0, 2.0])]
    got = ann.nearest(table(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hit = n = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(6000), -np.round(s, 12)))[:5]
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == [1, 2, 3, 4, 5]
        hit += len(set(best) & {x.vec_id for x in mine}) + (q == 0 and any(x.vec_id is None for x in mine))
        n += 5
        if q == 50:
            assert [x.vec_id for x in mine] == [100, 101, 102, 103, 104] and all(x.score == mine[0].score for x in mine)
    assert hit / n >= 0.9 and {x.query_id for x in got} == set(range(0, 6000, 50))


def _uniform(spark, tmp_path, v):
    import pyarrow.parquet as pq

    path = tmp_path / "vectors"
    path.mkdir()
    for i, rows in enumerate(np.array_split(np.arange(len(v)), 7)):
        flat = pa.ListArray.from_arrays(np.arange(0, len(rows) * v.shape[1] + 1, v.shape[1], dtype=np.int32), v[rows].ravel())
        pq.write_table(pa.table({"vec_id": rows, "embedding": flat, "score": rows, "found": rows}), path / f"{i}.parquet")
    return spark.read.parquet(str(path))


def _recall(v, got):
    u, hit = v / np.linalg.norm(v, axis=1)[:, None], 0
    asked = np.arange(0, len(v), 50)
    by = {q: g for q, g in got.groupby("query_id")}
    for q in asked:
        s = u @ u[q]
        s[q] = -9
        hit += (by[q].score.to_numpy() >= np.sort(s)[-5] - 1e-9).sum()
    return hit / (5 * len(asked))


def test_recall_on_uniform_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "PART", 300)  # buckets are split
    v = np.random.RandomState(3).randn(51_282, 64)
    assert _recall(v, ann.nearest(_uniform(spark, tmp_path, v), F.col("vec_id") % 50 == 0).toPandas()) >= 0.9


def test_a_third_of_equal_vectors(spark, tmp_path):
    r = np.random.RandomState(4)
    v = r.randn(9000, 24)
    same = np.sort(r.permutation(9000)[:3000])
    v[same] = v[same[0]]
    got = ann.nearest(_uniform(spark, tmp_path, v), F.col("vec_id") % 50 == 0).toPandas()
    assert _recall(v, got) >= 0.9
    for q in same[same % 50 == 0]:
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [x for x in same[:6] if x != q][:5]


def test_lonely_and_extreme_vectors(table):
    near = [(i, [1.0, 0.001 * i, 0.0]) for i in range(1, 40)]
    rows = near + [(0, [-1.0, 0.0, 0.0]), (50, [1e300, 1e300, 0.0]), (100, [1e-300, 0.0, 0.0]), (150, [1.0, 2.0])]
    got = ann.nearest(table(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 100].vec_id.tolist() == [1, 2, 3, 4, 5]
    assert got[got.query_id == 50].vec_id.tolist() == [39, 38, 37, 36, 35] and got[got.query_id == 0].vec_id.tolist()[0] == 50
    assert set(got.query_id) == {0, 50, 100} and got.score.between(-1.000001, 1.000001).all()


def test_few_vectors_return_all(table):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    got = ann.nearest(table(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in got] == [(2, round(0.5**0.5, 6)), (1, 0.0)]
    assert ann.nearest(table(rows, "vec_id long, embedding array<float>").limit(0), F.lit(True)).count() == 0


def test_probes_go_outwards():
    t = ann.Tables(8, 3)
    u = np.random.RandomState(1).randn(20, 8)
    u /= np.linalg.norm(u, axis=1)[:, None]
    visits = t.probes(u, 30)
    assert (visits[:, :, 0] == t.buckets(u)).all() and all(len(set(row)) == 30 for rows in visits for row in rows.tolist())
    at = t._places(u)
    for i in range(20):  # by squared distances to the borders crossed, counted anew
        for j in range(ann.TABLES):
            cost = {}
            for m in t.moves:
                slot = np.floor(at[i, j]).astype(int)
                away = np.where(m > 0, slot + m - at[i, j], np.where(m < 0, at[i, j] - (slot + m + 1), 0))
                cost[int(t._keys((slot + m)[None])[0]) * ann.TABLES + j] = (away**2).sum()
            mine = [cost[int(x)] for x in visits[i, j]]
            assert np.allclose(mine, sorted(cost.values())[:30])


def test_ordinal_thresholds_stay_ordered():
    r = np.random.RandomState(2)
    rows, grades = [], []
    for _ in range(600):
        g = r.randint(0, 3)
        rows.append((np.array([g, 10 + r.randint(5)]), np.array([1.0, 1.0])))
        grades.append(g)
    m = quality.Ordinal.fit(rows, np.array(grades))
    assert (np.diff(m.thresholds) > 0).all()
    p = m.tails(np.array([m.weights[[g, 10]].sum() for g in range(3)]))
    assert (np.diff(p.sum(1)) > 0).all() and (p[:, 0] >= p[:, 1]).all() and p[0, 0] < 0.3 < 0.7 < p[2, 1]


def test_quality_held_out(spark, sf, table, odd):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    got = quality.grades(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in got}
    assert share[1] >= 0.97 and share[0] <= 0.3
    few = table(odd)
    assert quality.grades(few, model).count() == len(odd) and quality.accepted(few, None).count() == len(odd)
    assert quality.fit(docs, labels.limit(0)) is None


def test_repeated_and_missing_labels(table):
    docs = table([(1, "good text", 0), (1, "another good text", 0), (2, "bad!!! $$$", 0), (None, "x", 0), (3, None, 0)], "doc_id long, text string, grade int").withColumn("hash", F.lit(1))
    labels = table([(1, 1, 0), (1, 1, 0), (2, 0, None), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.grades(docs, model).collect()}
    assert got[1].expected_grade > got[2].expected_grade and len(got) == 4
    assert quality.grades(docs.limit(0), model).count() == 0 and quality.accepted(docs, model).columns == docs.columns
    # expected grade and tails, recomputed from the weights
    at, value = quality.features("good text")
    score = (model.weights[at] * value).sum()
    tails = [1 - 1 / (1 + math.exp(-(t - score))) for t in model.thresholds]
    row = [r for r in quality.grades(table([(9, "good text")]), model).collect()][0]
    assert abs(row.expected_grade - sum(tails)) < 1e-9 and abs(row.p_at_least_1 - tails[0]) < 1e-9 and row.accepted == (tails[0] >= 0.5)


def test_network_equals_plain_loops():
    r = np.random.RandomState(5)
    data = [bytes(r.randint(65, 90, r.randint(1, 600)).tolist()) for _ in range(6)]
    rows = np.concatenate([langid.windows(d)[0] for d in data])
    net = langid.ByteNetwork.train(rows, np.arange(len(rows)) % 2, ["a", "b"])
    got = net.probabilities(rows)
    width = max(langid.WIDTHS)
    for row, p in zip(rows, got):
        x = net.embedding[row]
        pooled = np.full(net.filters.shape[1], -np.inf)
        for place in range(langid.WINDOW - width + 1):
            pooled = np.maximum(pooled, x[place : place + width].ravel() @ net.filters + net.bias)
        z = np.maximum(pooled, 0) @ net.output + net.output_bias
        e = np.exp(z - z.max())
        assert np.allclose(p, e / e.sum(), atol=1e-4)


def test_no_documents_to_learn_from(table):
    none = table([(1, "x", "en")], "doc_id long, text string, lang string").limit(0)
    assert langid.train(none) is None and langid.predict(none, None).count() == 0


def test_language_held_out(spark, sf, table, odd):
    got = QUERIES["op3_language_id"](spark, sf.replace("0.001", "0.01"))
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    net = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = [None, "", "12 34!", "the " * 50_000, "é"]
    langs, scores = langid.identify(texts, net)
    assert langs[:3] == ["und"] * 3 and langs[3] in net.languages and langs[4] in net.languages
    assert langid.identify(["x"], None) == (["und"], [0.0])
    assert langid.predict(table(odd), net, keep={"doc_id": F.col("doc_id")}).count() == len(odd)


def test_every_language_is_learned(table, monkeypatch):
    langs = [f"l{i:04}" for i in range(1020)]
    docs = table([(i, f"text of {lang}", lang) for i, lang in enumerate(langs)] + [(-1, "no language", None)], "doc_id long, text string, lang string")
    learned = []
    monkeypatch.setattr(langid.ByteNetwork, "train", classmethod(lambda cls, rows, y, languages: learned.extend(languages)))
    langid.train(docs)
    assert learned == langs


def test_languages_of_many_documents_are_learned(spark, table, monkeypatch):
    docs = table([], "doc_id long, text string, lang string, u int, window int, count int").unionByName(spark.range(60_000).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id % 1000) as lang", "1 as u", "2 as window", "3 as count"))
    learned = []
    monkeypatch.setattr(langid.ByteNetwork, "train", classmethod(lambda cls, rows, y, languages: learned.append((len(rows), languages))))
    langid.train(docs)
    assert len(learned[0][1]) == 1000 and learned[0][0] < 10_000
    learned.clear()
    langid.train(table([(1, "word " * 200_000, "x"), (2, "12 34", "none")], "doc_id long, text string, lang string"))
    assert learned[0][1] == ["x"] and learned[0][0] <= 2 * langid.WINDOWS


def test_a_bucket_that_most_queries_visit(spark, table, monkeypatch, tmp_path):
    """All vectors lie close together, so all queries visit the same buckets; tasks stay small and results the same."""
    r = np.random.RandomState(4)
    v = 1 + 0.02 * r.randn(1500, 6)
    vectors = table([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    read = lambda: sorted((x.query_id, x["rank"], x.vec_id) for x in ann.nearest(vectors, F.col("vec_id") % 5 == 0).collect())
    want, compare, seen = read(), ann._compare, tmp_path / "seen"
    seen.mkdir()

    def noted(k):
        task = compare(k)

        def run(left, right):
            (seen / f"{right.num_rows}").touch()
            return task(left, right)

        return run

    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "_compare", noted)
    assert read() == want and 64 < max(int(p.name) for p in seen.iterdir()) < 110



def test_windows_cover_every_place():
    data = bytes(range(256)) * 5
    rows, weight = langid.windows(data)
    assert weight.sum() >= len(data) - 3
    seen = {tuple(r[i : i + 4]) for r in rows for i in range(langid.WINDOW - 3)}
    assert all(tuple(data[i : i + 4]) in seen for i in range(len(data) - 3))
    assert len(langid.windows(b"")[0]) == 1


@pytest.mark.parametrize("name", ["op1_nearest"])
def test_recall_on_the_table(spark, sf, name):
    import pandas as pd

    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.array(e.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = QUERIES[name](spark, sf).toPandas()
    assert isinstance(got, pd.DataFrame)
    hit = 0
    for q in np.nonzero(e.vec_id % 50 == 0)[0]:
        s = x @ x[q]
        s[q] = -9
        hit += len(set(e.vec_id[np.argsort(-s)[:5]]) & set(got[got.query_id == e.vec_id[q]].vec_id))
    assert hit / len(got) >= 0.9
