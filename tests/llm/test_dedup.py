import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import _common
from lodestar.llm import exact_dedup as X
from lodestar.llm import near_dup as N
from lodestar.llm.components import components


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_marks(table, odd):
    rows = [*odd, (9, "a  b"), (8, "a\tb"), (7, "a b ")]
    keyed = table(rows).select("doc_id", "text", X.digest(F.col("text")).alias("k"))
    got = X.mark_duplicates(keyed, "k", "doc_id", len(rows)).collect()
    groups = defaultdict(list)
    for r in got:
        assert r.k == hashlib.sha256(norm(r.text).encode()).hexdigest()
        groups[r.k].append(r)
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert sum(r.kept for r in g) == 1 and all(r.group_size == len(g) and r.keep_id == (min(ids) if ids else None) for r in g)
        assert [r.doc_id for r in g if r.kept] == [min(ids) if ids else None]


def test_exact_dedup_keeps_other_columns(table):
    docs = table([(2, "x", 1, 2), (1, "x", 3, 4), (3, "y", 5, 6)], "doc_id long, text string, keep_id int, kept int")
    assert sorted(tuple(r) for r in X.exact_dedup(docs).collect()) == [(1, "x", 3, 4), (3, "y", 5, 6)]
    assert X.exact_dedup(docs.limit(0)).count() == 0


def test_filter_holds_every_repeated_key(table):
    rows = [(i, str(i % 700)) for i in range(1000)]
    keys = table(rows).select("doc_id", F.col("text").alias("k"))
    got = X.mark_duplicates(keys, "k", "doc_id", 1000).where("kept").count()
    assert got == 700


def test_filter_in_slices(table, monkeypatch):
    monkeypatch.setattr(X, "MAX_BLOCKS", 1)
    rows = [(i, str(i % 6000)) for i in range(9000)]
    keys = table(rows).select("doc_id", F.col("text").alias("k"))
    got = X.mark_duplicates(keys, "k", "doc_id", 9000).collect()
    assert len(got) == 9000 and all(r.kept == (r.doc_id < 6000) and r.group_size == (2 if int(r.k) < 3000 else 1) and r.keep_id == int(r.k) for r in got)
    # each slice was finished by itself: no filter is sent around any more
    assert "Broadcast" not in X.mark_duplicates(keys, "k", "doc_id", 9000)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        X.mark_duplicates(keys.withColumn("Kept", F.lit(1)), "k", "doc_id", 9000)


@pytest.mark.parametrize("sent", [16384, -1])
def test_rows_among(table, monkeypatch, sent):
    monkeypatch.setattr(_common, "BITMAPS_SENT", sent)
    docs = table([(i, "x") for i in range(70_000)]).repartition(3, "doc_id").withColumn("uid", F.monotonically_increasing_id()).withColumn("__part", F.lit(1))
    docs.write.parquet(path := _common.shared_path(docs.sparkSession, "t"))
    docs = docs.sparkSession.read.parquet(path)
    some = docs.where("doc_id % 7 = 0").select("uid")
    assert _common.rows_among(docs, "uid", some).agg(F.count_if(F.expr("doc_id % 7 = 0")), F.count("*")).first() == (10_000, 10_000)
    rest = _common.rows_among(docs, "uid", some, inside=False)
    assert set(rest.columns) == set(docs.columns) and rest.agg(F.count_if(F.expr("doc_id % 7 = 0")), F.count("*")).first() == (0, 60_000)


@pytest.fixture
def shifting(spark, monkeypatch):
    """Executors come and go: every stored table changes how the next scan cuts its files."""
    stored, turns = _common.stored, []

    def store(df, name, path=None):
        turns.append(name)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(1 + 3 * (len(turns) % 3)))
        spark.conf.set("spark.sql.files.openCostInBytes", str([1 << 22, 1, 1 << 12][len(turns) % 3]))
        return stored(df, name, path)

    for module in (_common, X, N):
        monkeypatch.setattr(module, "stored", store)
    yield turns
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("files", [True, False])
def test_rows_keep_their_numbers_when_scans_change(spark, tmp_path, shifting, files):
    rows = near_rows(5, 8, 12, 60)
    rows += [(1000 + i, rows[i][1]) for i in range(0, 96, 3)] + [(3, rows[3][1]), (None, None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(path)
    docs = spark.read.parquet(path)
    docs = docs if files else docs.limit(len(rows))
    numbered = _common.with_uid(docs, "uid")
    read = lambda: {tuple(r) for r in numbered.collect()}
    first = read()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    assert read() == first and len(first) == len(rows) == len({r[2] for r in first})
    assert ("files" in shifting) == files and ("rows" in shifting) == (not files)
    want = sorted(min(i for i, t in rows if i is not None and norm(t) == text) if text else -1 for text in {norm(t) for _, t in rows})
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in X.exact_dedup(docs).collect()) == want
    classes = {r.class_id for r in N.near_duplicates(docs).collect()}
    assert sorted((r.doc_id for r in N.near_dedup(docs).collect()), key=str) == sorted(classes, key=str)


def test_rows_that_come_twice_are_stored(table, shifting):
    docs = table([(i, "x") for i in range(50)])
    twice = docs.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    got = _common.with_uid(twice, "uid").collect()
    assert len({r.uid for r in got}) == 100 and "rows" in shifting
    own = docs.withColumn("_metadata", F.lit("mine"))
    assert len({r.uid for r in _common.with_uid(own, "uid").collect()}) == 50


def test_components_of_a_long_chain(spark, table):
    edges = table([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 63


def brute(rows):
    sets = [(i, frozenset(N.shingles(t or "").tolist())) for i, t in rows]
    classes = defaultdict(list)
    for i, s in sets:
        if s:
            classes[s].append(i)
    keys = list(classes)
    parent, links = {k: k for k in keys}, dict.fromkeys(keys, 0)

    def find(k):
        while parent[k] is not k:
            k = parent[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if 9 * both >= 4 * (len(keys[a]) + len(keys[b])):
                links[keys[a]] += 1
                links[keys[b]] += 1
                parent[find(keys[a])] = find(keys[b])
    first = defaultdict(lambda: 1 << 60)
    for k in keys:
        first[find(k)] = min(first[find(k)], *classes[k])
    return {i: (first[find(s)], links[s], len(classes[s])) if s else (i, 0, 1) for i, s in sets}


def near_rows(seed, groups, size, words):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(groups):
        base = r.choices(vocabulary, k=words)
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, 5)):
                t[r.randrange(words)] = r.choice(vocabulary)
            rows.append(" ".join(t))
    return [(i, t) for i, t in enumerate(rows)]


def test_links_equal_brute_force(table):
    rows = near_rows(1, 6, 20, 150) + [(1000, "one two"), (1001, "One, two!"), (1002, None), (1003, ""), (1004, "x " * 30_000)]
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in N.near_duplicates(table(rows)).collect()}
    assert got == brute(rows)


def test_large_group_goes_by_tiles(table, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rows = near_rows(2, 1, 90, 200)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in N.near_duplicates(table(rows)).collect()}
    assert got == brute(rows)


def test_near_dedup_keeps_the_first(table, odd):
    docs = table([*odd, (20, "the quick brown fox jumps over the lazy dog"), (19, "The quick brown fox jumps over the lazy dog!")])
    kept = [r.doc_id for r in N.near_dedup(docs).collect()]
    assert 19 in kept and 20 not in kept and kept.count(4) == 1 and kept.count(None) == 1
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_matrix_and_single_counts_agree(monkeypatch):
    r = random.Random(3)
    import numpy as np

    sets = [np.unique(np.array([r.randrange(300) for _ in range(r.randint(1, 400))], np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    one = N.verified(sets, sets, i, j)
    monkeypatch.setattr(N, "DENSE_PAIRS", 0)
    assert (N.verified(sets, sets, i, j) == one).all()
