import datetime

import pytest
from pyspark.sql import functions as F

from lodestar.functions import scalars as S
from lodestar.functions import text as T


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


CASES = [
    (T.normalize, "Kiln VI", "kiln 6"),
    (T.normalize, "kiln vi ii", "kiln 6 2"),
    (T.normalize, "40 ix", "40 ix"),
    (T.normalize, "iv kiln", "iv kiln"),
    (T.normalize, "QX-8  Mini_3", "qx8 mini3"),
    (T.normalize, "كتاب‌ي ۱۲٣", "کتاب ی 123"),
    (T.normalize, None, ""),
    (T.normalize, "Final Fantasy (VII)", "final fantasy (7)"),
    (T.normalize_sku, "ZK/77 05", "zk7705"),
    (T.collapse, "Old Mill 9", "oldmill9"),
    (T.tokenize, " a-b  c1! ", ["a", "b", "c1"]),
    (T.mask_digits, "call 12345678 now", "call # now"),
    (T.mask_digits, "x" * 81, "[long query]"),
    (T.en_to_fa, "sghl", "سلام"[:1] + "لام"),
    (T.fa_to_en, "سلام", "sghl"),
    (T.en_to_fa, "HF-1502", "HF-1502"),
    (T.is_suspicious, "1 union all select 2", True),
    (T.is_suspicious, "lamp -- blue", False),
    (T.is_suspicious, "x' -- y", True),
    (T.query_clean, "Salt &amp;amp; Miller#039s", "Salt & Miller's"),
    (T.clean_text, "a&lt;b&gt;<i>c</i>  d", "a c d"),
    (T.clean_tags, "a bc 7 NULLs", "bc 7 NULLs"),
    (lambda c: T.index_description(c, 7), "one two three", "one two"),
    (lambda c: T.index_description(c, 9), "one two three", "one two"),
    (T.length_bucket, "a b c d e f", 5),
    (lambda c: T.resolve_url(c, "https://x.y/"), "/a/b.png", "https://x.y/a/b.png"),
    (lambda c: T.resolve_url(c, "https://x.y"), "//cdn/a", "//cdn/a"),
    (T.outcome, "Operation timed out", "timeout"),
]


@pytest.mark.parametrize("function, value, expected", CASES)
def test_case(spark, function, value, expected):
    assert one(spark, function, value) == expected


def test_normalize_is_idempotent(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(T.normalize("text").alias("n"))
    assert docs.where(T.normalize("n") != F.col("n")).count() == 0


def test_structs(spark):
    row = spark.sql("SELECT 'Size: 4 | red | Kind: ' AS a, 'redemption2' AS b, 'app;dur=1.5, db;dur=20' AS c").select(
        T.compose_specs(T.attribute_pairs("a"), F.array(F.lit("t"))).alias("a"), T.name_and_digits(F.col("b")).alias("b"), T.server_timing("c").alias("c"), T.transpositions(F.lit("abc")).alias("d"), T.cap(F.lit("a b c"), 100, 2).alias("e")
    ).first()
    assert row.a == "Size: 4 | red | t" and tuple(row.b) == ("redemption", "2") and row.c == {"app": 1.5, "db": 20.0} and row.d == ["bac", "acb"] and tuple(row.e) == ("a b", True)


def test_serialized_titles():
    blob = 'a:1:{i:0;a:2:{s:5:"title";s:5:"é12";s:1:"x";a:1:{s:5:"title";s:1:"b";}}}'.replace("s:5:\"é12\"", "s:4:\"é12\"")
    assert T.serialized_titles(blob) == ["é12", "b"]
    assert T.serialized_titles("") == [] and T.serialized_titles("a:1:{i:0;s:9:\"x\";}") is None
    assert T.serialized_titles("a:1:{s:5:&quot;title&quot;;s:1:&quot;b&quot;;}") == ["b"]


def test_dates(spark):
    days = [("2000-07-15", (1379, 4, 25)), ("1999-09-10", (1378, 6, 19)), ("2025-03-20", (1403, 12, 30)), ("2025-03-21", (1404, 1, 1)), ("2024-03-20", (1403, 1, 1))]
    got = spark.createDataFrame([(d,) for d, _ in days], "d string").select(S.jalali(F.to_date("d")).alias("j")).collect()
    assert [tuple(r.j) for r in got] == [x for _, x in days]
    row = spark.sql("SELECT '2024-02-01' AS a, '2024-02-01 10:00:00' AS b, 'x' AS c").select(S.upper_bound(F.col("a")).alias("a"), S.upper_bound(F.col("b")).alias("b"), S.parse_date(F.col("c")).alias("c")).first()
    assert row.a == datetime.datetime(2024, 2, 2) and row.b == datetime.datetime(2024, 2, 1, 10) and row.c is None


def test_weights(spark):
    row = spark.sql("SELECT array(0.9D, 0.2D, 0.3D) AS w, array(3.0, 4.0) AS v, array(0.0, 0.0) AS z").select(S.cap_heaviest(F.col("w")).alias("w"), S.unit(F.col("v")).alias("v"), S.unit(F.col("z")).alias("z")).first()
    assert row.w == pytest.approx([0.5, 0.2, 0.3]) and row.v == pytest.approx([0.6, 0.8]) and row.z == [0, 0]
