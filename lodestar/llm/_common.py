"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``; only where it is unset (tests on one
    machine) is a temporary folder used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors or not."""
    path = path or shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` doesn't use."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        n = f"__{name}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def ref(name: str):
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


BITMAP_BITS = 32768  # what one row of bitmap_construct_agg holds
BITMAPS_SENT = 16384  # rows of 4 KiB that are sent to all tasks, at most


def bit_set(bitmap, bit):
    """Whether the bitmap has this bit."""
    byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1


ROW_BITS = 24  # of a row's number within its file


def _rows_of_files(docs: DataFrame) -> bool:
    """Whether ``docs`` is a table of files with columns and rows chosen by deterministic expressions, and nothing else."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.children().head()
    return plan.nodeName().startswith(("Relation", "LogicalRelation")) and plan.children().isEmpty()


def _by_file(docs: DataFrame, uid: str) -> DataFrame | None:
    """``docs`` with each row's file (39 bits of its path's hash) and number in it as ``uid``; None where they don't name the rows."""
    if "_metadata" in {c.lower() for c in docs.columns} or not _rows_of_files(docs):
        return None
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        files = docs.select(path.alias("file"), row.alias("row")).groupBy("file").agg(F.max("row").alias("last"))
    except AnalysisException:  # files of a kind that doesn't number its rows
        return None
    number = lambda c, seed: F.xxhash64(c, F.lit(seed)).bitwiseAND((1 << (63 - ROW_BITS)) - 1)
    seeds = range(4)
    # no column of the files is read for this
    count, last, *distinct = stored(files, "files").agg(F.count(F.lit(1)), F.coalesce(F.max("last"), F.lit(0)), *(F.count_distinct(number("file", s)) for s in seeds)).first()
    sound = [s for s in seeds if distinct[s] == count]  # no two files meet
    if not sound or last >= 1 << ROW_BITS:
        return None
    return docs.withColumn(uid, F.shiftleft(number(path, sound[0]), ROW_BITS) + row)


def with_uid(docs: DataFrame, uid: str) -> DataFrame:
    """``docs`` with a number of each row that is the same whenever it's read, however many executors there are and however files are split.

    Rows of files are named by file and place; others (joined, exploded, limited ones) are stored with their number.
    """
    named = _by_file(docs, uid)
    return stored(docs.withColumn(uid, F.monotonically_increasing_id()), "rows") if named is None else named


def rows_among(df: DataFrame, uid: str, uids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``uid`` is (or isn't) among the column ``uid`` of ``uids``; both come from ``with_uid``.

    Such numbers count up within a file or partition, so a bit a row says which are meant: those bitmaps go to
    the rows (64 MiB stand for some 500 million rows), and no row of ``df`` moves. Beyond that size it's a join.
    """
    bucket, bitmap = fresh(df, "bucket", "bitmap")
    at = lambda c: (F.shiftright(c, 15).alias(bucket), c.bitwiseAND(BITMAP_BITS - 1))
    b, bit = at(uids["uid"])
    marks = stored(uids.select(b, bit.alias("bit")).groupBy(bucket).agg(F.bitmap_construct_agg("bit").alias(bitmap)), "marks")
    if marks.count() > BITMAPS_SENT:
        return df.join(uids.select(F.col("uid").alias(uid)), uid, "left_semi" if inside else "left_anti")
    b, bit = at(F.col(uid))
    met = df.withColumn(bucket, b).join(F.broadcast(marks), bucket, "left")
    hit = F.coalesce(bit_set(F.col(bitmap), bit.cast("int")), F.lit(False))
    return met.where(hit if inside else ~hit).select([ref(c) for c in df.columns])


_cache_owner: list = [None, None]


def sole_cache(owner: str, clear) -> None:
    """A Python worker outlives its tasks: when another operator starts in it, the one before forgets what it remembered and the memory goes back to the system."""
    if _cache_owner[0] != owner:
        if _cache_owner[1] is not None:
            _cache_owner[1]()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass
        _cache_owner[:] = [owner, clear]


ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, in slices of ``ROWS_AT_ONCE`` rows and about ``BYTES_AT_ONCE`` bytes at most."""
    ship(df.sparkSession)

    def slices(batches):
        for b in batches:
            step = max(1, min(ROWS_AT_ONCE, b.num_rows * BYTES_AT_ONCE // max(1, b.nbytes)))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)

    return df.mapInArrow(lambda batches: function(slices(batches)), schema)
