from pyspark.sql import functions as F

import corpus_pipeline as P
from lodestar.llm import near_dup, packing, pii, quality
from lodestar.llm.registry import QUERIES, SQL


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        stage(spark, kept, sf).write.mode("overwrite").parquet(path)
        before, kept = kept, spark.read.parquet(path)
        assert sorted(kept.columns) == sorted(docs.columns) and kept.count() <= before.count()
        if name == "quality":
            model = quality.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
            want = {r.doc_id for r in quality.grades(before, model).where("accepted").collect()}
        elif name == "exact_dedup":
            t = before.toPandas().assign(n=lambda d: d.text.str.replace(r"[\x20\x09-\x0D]+", " ", regex=True))
            want = set(t.sort_values("doc_id").drop_duplicates("n").doc_id)
        elif name == "near_dedup":
            want = {r.doc_id for r in near_dup.near_duplicates(before).where("kept").collect()}
        else:
            want = {r.doc_id for r in before.select("doc_id").collect()}
            assert pii.pii_spans(kept).where(F.size("base") > 0).count() == 0
        assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    packed = P.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == want
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.CAPACITY).count() == 0


def test_registry():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13 and set(SQL) <= set(QUERIES)


def test_exact_dedup_equals_duckdb(spark, sf, duck):
    got = QUERIES["op8_exact_dedup"](spark, sf)
    want = duck.execute(SQL["op8_exact_dedup"])
    order = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.select(order).collect()) == sorted(want.fetchall())
