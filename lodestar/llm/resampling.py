r"""Importance resampling towards a target distribution, on hashed word n-grams.

1. DuckDB counts inside each Spark task: SQL unnests a slice's words, a window puts each beside its
   successor, the distinct features get their zlib CRC-32 by a registered function, and each
   document's buckets are counted. Those counts are written to Parquet, by Spark, so that tasks may
   run again; texts are read once.
2. Spark merges the counts of corpus and target into a gain for each bucket, and joins those
   ``BUCKETS`` rows with the documents' counts for their weights.
3. Gumbel noise from a hash of the id makes the highest scores a draw without replacement. Ranks come
   from a sort by range and prefix sums over its partitions.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, ref, stored, table

BUCKETS = 10_000
LEAST_WORDS, SHARE, SEED = 20, 25, 7
TASK_MEMORY = "256MB"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The documents of a slice with the buckets of their features; ``texts`` is (doc, text).
COUNTS = rf"""
WITH split AS (SELECT doc, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
word AS (SELECT doc, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split),
run AS (SELECT doc, word, lead(word) OVER (PARTITION BY doc ORDER BY place) AS next FROM word),
features AS MATERIALIZED (SELECT doc, unnest([word, word || ' ' || next]) AS feature FROM run),
code AS (SELECT feature, crc32(feature) % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM features WHERE feature IS NOT NULL)),
counted AS (SELECT doc, bucket, count(*) AS n FROM features JOIN code USING (feature) GROUP BY doc, bucket),
listed AS (SELECT doc, list(bucket) AS buckets, list(n) AS counts FROM counted GROUP BY doc)
SELECT doc, coalesce(len(words), 0)::bigint AS n_words, coalesce(buckets, [])::int[] AS buckets, coalesce(counts, [])::bigint[] AS counts FROM split LEFT JOIN listed USING (doc) ORDER BY doc"""


def _crc32(column: pa.ChunkedArray) -> pa.Array:
    return pa.array(map(zlib.crc32, column.cast(pa.binary()).to_pylist()), pa.uint32())


def _connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": TASK_MEMORY})
    con.create_function("crc32", _crc32, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def bucket_counts(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """Stored: (uid, id, n_words, buckets, counts) of every row of ``docs``; ``uid`` numbers the stored rows."""
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, uid = _connection(), TaskContext.get().partitionId() << 33
        for b in batches:
            con.register("texts", pa.table({"doc": pa.array(range(b.num_rows), pa.int64()), "text": b.column(1)}))
            t = con.sql(COUNTS).to_arrow_table().combine_chunks()
            con.unregister("texts")
            one = lambda c: t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type)
            ids = pa.array(range(uid, uid + b.num_rows), pa.int64())
            uid += b.num_rows
            yield pa.RecordBatch.from_arrays([ids, b.column(0), one("n_words"), one("buckets").cast(pa.list_(pa.int32())), one("counts").cast(pa.list_(pa.int64()))], names=["uid", "id", "n_words", "buckets", "counts"])
        con.close()

    kind = rows.schema["id"].dataType.simpleString()
    return stored(map_arrow(rows, run, f"uid long, id {kind}, n_words long, buckets array<int>, counts array<long>"), name)


def _listed(counted: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` with bucket and n: a row for each bucket of each document, one with nulls for a document without any."""
    each = counted.select(*keep, F.explode_outer(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.select(*keep, F.col("x.buckets").alias("bucket"), F.col("x.counts").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of all ``BUCKETS`` buckets, from the documents' and the target texts' counts."""
    merged = lambda df, name: _listed(df).where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias(name))
    spark = corpus.sparkSession
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(merged(corpus, "s"), "bucket", "left").join(merged(target, "t"), "bucket", "left").fillna(0)
    both = stored(both.select("bucket", F.col("s").cast("double").alias("s"), F.col("t").cast("double").alias("t")), "buckets")
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + BUCKETS) / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(id_text: Column, seed: int = SEED) -> Column:
    """Noise in thousandths that the id's hash decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_text, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, from 0 in this order over all of them: sorted by ranges, no partition holds all.

    ``rows`` should be stored; the order should be total, so that equal keys don't make one range large.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in ordered.groupBy(part.alias("part")).count().collect())  # a row a partition
    bases = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    based = rows.sparkSession.createDataFrame(bases, "part long, base long")
    return ordered.withColumn("part", part).join(F.broadcast(based), "part").withColumn("place", F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "base")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for those not drawn.

    Features are the words and pairs of neighbouring words of a whole text, repeats counted. ``weight``
    is the floored mean of their gains (0 without features), ``score`` adds the noise of the id. Of the
    rows with ``least_words`` words or more, ``share`` percent (floored) with the highest scores are
    drawn; ties go to the smaller id, null ids last, repeated rows in any order. A null text has no
    words. A null id has the noise of an empty one. Other columns are ignored; an empty table gives no
    rows, an empty target equal counts of 0 for all buckets.
    """
    corpus = bucket_counts(docs, id_col, text_col, "corpus-counts")
    gains = bucket_gains(corpus, bucket_counts(target.withColumn("id", F.lit(0)), "id", target_text, "target-counts"))
    each = _listed(corpus, "uid", "id", "n_words").join(F.broadcast(gains), "bucket", "left")  # ``BUCKETS`` rows
    sums = each.groupBy("uid", "id", "n_words").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_features"), F.coalesce(F.sum(F.col("n") * F.col("gain")), F.lit(0)).cast("long").alias("total"))
    n = F.col("n_features")
    weight = F.when(n > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    scored = sums.withColumn("weight", weight.cast("long")).withColumn("score", F.col("weight") + gumbel(F.col("id").cast("string"), seed))
    scored = stored(scored.select("uid", "id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("eligible")), "scores")
    drawn = scored.where("eligible").count() * share // 100
    placed = numbered(scored, F.desc("eligible"), F.desc("score"), F.asc_nulls_last("id"), F.asc("uid"))
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return placed.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", rank.alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn towards the texts of ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of the features' bytes, with its table made from the polynomial.
OP12_SQL = rf"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::ubigint) ELSE a >> 1 END) AS v FROM range(256) r(i))),
src AS (SELECT 0 AS kind, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS (SELECT kind, k, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM src),
feat AS (SELECT kind, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feat)),
code AS (SELECT f, (xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substring(h, 2 * i + 1, 2))::int::ubigint)),
        lambda a, x: xor(a >> 8, t[xor(a % 256, x)::bigint + 1])), 4294967295::ubigint) % {BUCKETS})::bigint AS b FROM hexed, tab),
cnt AS (SELECT kind, k, b, count(*) AS n FROM feat JOIN code USING (f) GROUP BY ALL),
tot AS (SELECT sum(n) FILTER (WHERE kind = 0)::double AS ss, sum(n) FILTER (WHERE kind = 1)::double AS tt FROM cnt),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (coalesce(ss, 0) + {BUCKETS}) / ((s + 1) * (coalesce(tt, 0) + {BUCKETS}))))::bigint AS gain
    FROM (SELECT b, coalesce(sum(n) FILTER (WHERE kind = 0), 0)::double AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0)::double AS t FROM cnt GROUP BY b), tot),
doc AS (SELECT doc_id, len(w) AS words, coalesce(m, 0)::bigint AS n_features, CASE WHEN m > 0 THEN (total - ((total % m) + m) % m) // m ELSE 0 END AS weight
    FROM split LEFT JOIN (SELECT k, sum(n)::bigint AS m, sum(n * gain)::bigint AS total FROM cnt JOIN gain USING (b) WHERE kind = 0 GROUP BY k) USING (k) WHERE kind = 0),
fin AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substring(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint AS score FROM doc),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM fin WHERE words >= {LEAST_WORDS} QUALIFY rank <= (SELECT floor({SHARE} * count(*) / 100) FROM fin WHERE words >= {LEAST_WORDS}))
SELECT doc_id, n_features, weight::bigint AS weight, score::bigint AS score, rank FROM fin LEFT JOIN drawn USING (doc_id)
"""
