"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Pass 1 counts, for every row, the bits its hash sets in a blocked Bloom filter; bits set at least
twice become the filter of *possibly repeated* hashes. Pass 2 probes it: rows that miss can't have a
twin and pass straight through, the few others shuffle and are grouped by their full SHA-256.

The filter takes ``BITS_PER_ROW`` bits a row. It's split by hash range into slices of at most
``MAX_BLOCKS`` blocks of 4 KiB (32 MiB, 16 million rows); each slice is finished and stored before the
filter of the next is made, so one is sent around at a time. Only hashes and row numbers take part; the
texts of rows that stay are never moved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BITMAP_BITS, bit_set, fresh, ref, rows_among, shared_path, stored, table, with_uid

BITS_PER_ROW = 16
HASHES = 3
MAX_BLOCKS = 8192


def normalised(text: Column) -> Column:
    r"""Null as empty; every run of ``[\x20\x09-\x0D]`` as one space."""
    # runs that are one plain space already needn't be replaced
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITMAP_BITS)).cast("int")


def repeated_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Pass 1: (block, bitmap of the bits set by two rows or more)."""
    k = ref(key)
    bits = keys.select(_block(k, blocks).alias("block"), F.explode(F.array(*(_bit(k, i) for i in range(HASHES)))).alias("bit"))
    twice = bits.groupBy("block", "bit").count().where(F.col("count") >= 2)
    return twice.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bitmap"))


def _marked(df: DataFrame, key: str, id_col: str, blocks: int) -> DataFrame:
    """``mark_duplicates`` of rows whose filter has at most ``MAX_BLOCKS`` blocks."""
    block, bitmap, uid, first, same, size = fresh(df, "block", "bitmap", "uid", "first", "same", "size")
    out = [ref(c) for c in df.columns]
    # stored, so that its true size is known before it is sent around
    filt = stored(repeated_filter(df, key, blocks), "bloom").select(F.col("block").alias(block), F.col("bitmap").alias(bitmap))
    k = ref(key)
    probed = df.withColumn(block, _block(k, blocks)).join(F.broadcast(filt), block, "left")
    maybe = F.col(bitmap).isNotNull()
    for i in range(HASHES):
        maybe = maybe & bit_set(F.col(bitmap), _bit(k, i))
    maybe = F.coalesce(maybe, F.lit(False))
    alone = probed.where(~maybe).select(*out, ref(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    some = stored(probed.where(maybe).select(*out, F.monotonically_increasing_id().alias(uid)), "candidates")
    rank = F.struct(ref(id_col).isNull().alias("n"), ref(id_col).alias("id"), F.col(uid).alias("u"))
    groups = stored(some.groupBy(k.alias(same)).agg(F.min(rank).alias(first), F.count(F.lit(1)).alias(size)), "groups")
    both = some.join(groups, k == F.col(same))
    shuffled = both.select(*out, F.col(f"{first}.id").alias("keep_id"), F.col(size).alias("group_size"), (F.col(uid) == F.col(f"{first}.u")).alias("kept"))
    return alone.unionAll(shuffled)


def mark_duplicates(df: DataFrame, key: str, id_col: str, rows: int) -> DataFrame:
    """``df`` with (keep_id, group_size, kept) of rows equal in ``key``; one row stays of each group.

    The smallest id stays; a null id comes after all others; rows with equal ids (repeated rows) tie
    by their position in ``df``. ``key`` must not be null, and ``df`` must not have those three columns
    yet (a ValueError). ``rows`` is the number of rows of ``df``, which should be stored: it's read twice.
    """
    if taken := {"keep_id", "group_size", "kept"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns in the way: {sorted(taken)}")
    blocks = max(1, -(-rows * BITS_PER_ROW // BITMAP_BITS))
    slices = -(-blocks // MAX_BLOCKS)
    if slices == 1:
        return _marked(df, key, id_col, blocks)
    (part,) = fresh(df, "slice")
    path = shared_path(df.sparkSession, "slices")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(ref(key), F.lit("slice")), F.lit(slices)).cast("int"))
    dealt.write.partitionBy(part).parquet(path)  # a folder a slice, so that each is read by itself
    dealt = df.sparkSession.read.schema(dealt.schema).parquet(path)
    own = lambda i: dealt.where(F.col(part) == i).select([ref(c) for c in df.columns])
    return reduce(DataFrame.unionAll, [stored(_marked(own(i), key, id_col, MAX_BLOCKS), "marked") for i in range(slices)])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` but the later ones of each group of equal texts.

    Null texts count as empty and so equal each other. Texts of a table are read twice, for their hashes
    and to pass on (see ``with_uid``). An empty table gives an empty table.
    """
    (uid,) = fresh(docs, "uid")
    rows = with_uid(docs, uid)
    keys = stored(rows.select(F.col(uid).alias("uid"), ref(id_col).alias("id"), F.unhex(digest(ref(text_col))).alias("key")), "digests")
    gone = mark_duplicates(keys, "key", "id", keys.count()).where("not kept").select("uid")
    return rows_among(rows, uid, gone, inside=False).drop(uid)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = table(spark, sf_dir, "documents")
    keys = stored(docs.select("doc_id", digest(F.col("text")).alias("text_sha256")), "digests", shared_path(spark, "digests"))
    marked = mark_duplicates(keys, "text_sha256", "doc_id", keys.count())
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
