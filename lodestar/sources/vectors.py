"""Vector tables with their checks, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _digest(rows: DataFrame):
    """(n, ids, dim, checksum) of stored vectors; the checksum doesn't depend on the order of rows."""
    each = F.xxhash64("id", "embedding").cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("checksum"))


def write_vectors(vectors: DataFrame, path: str, model: str) -> None:
    """SNK4: ``vectors`` (id, embedding) as floats, with a meta table of count, length, model and checksum beside them."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    back = rows.sparkSession.read.parquet(f"{path}/vectors")
    _digest(back).withColumn("model", F.lit(model)).write.mode("overwrite").parquet(f"{path}/meta")


def read_vectors(spark: SparkSession, path: str, model: str | None = None, off: float = 1e-3) -> DataFrame:
    """SRC8: the vectors, if they are what their meta table says: model, count, checksum, one length, unique ids, finite, of length one."""
    rows, meta = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/meta").first()
    found = _digest(rows).first()
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    # null as well as not a number
    bad = rows.agg(F.count_if(F.size("embedding") != meta.dim).alias("length"), F.count_if(~F.coalesce(F.abs(norm - 1) <= off, F.lit(False)) | F.isnan(norm)).alias("norm")).first()
    checks = {"model": model is None or meta.model == model, "count": found.n == meta.n, "checksum": found.checksum == meta.checksum, "ids": found.ids == found.n, "length": not bad.length, "norm": not bad.norm}
    if wrong := [k for k, ok in checks.items() if not ok]:
        raise ValueError(f"vectors at {path}: {', '.join(wrong)}")
    return rows
