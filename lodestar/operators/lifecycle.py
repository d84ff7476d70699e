"""Bundles: written as versions, checked, switched by a pointer, compared."""

from __future__ import annotations

import fcntl
import json
import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 4
UNIT_TOLERANCE = 1e-3


def difference(live: DataFrame, staged: DataFrame, key: str = "product_id") -> DataFrame:
    """One row: rows of both sides, added and removed keys, and rows that changed."""
    other = [c for c in live.columns if c != key and c in staged.columns]
    a, b = (df.select(F.col(key), F.xxhash64(*other).alias(n)) for df, n in ((live, "a"), (staged, "b")))
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), key, "full")
    return both.agg(F.count("x").alias("live"), F.count("y").alias("staged"), F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("y").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def vector_report(vectors: DataFrame) -> DataFrame:
    """One row: count, dimensions, distinct ids, whether all numbers are finite and all vectors of unit length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"), F.bool_and(finite).alias("finite"), F.bool_and(F.abs(norm - 1) <= UNIT_TOLERANCE).alias("unit"))


def malformed(rows: DataFrame, parsed: str = "titles", raw: str = "feature", key: str = "product_id") -> DataFrame:
    """One row: how many blobs couldn't be parsed, and the first ten of their ids."""
    bad = rows.where(F.col(parsed).isNull() & F.col(raw).isNotNull())
    first = bad.orderBy(key).limit(10).agg(F.collect_list(key).alias("first"))
    return bad.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(first))


class Bundles:
    """Versions of a set of tables in one folder; ``current.json`` names the live one.

    The folder must be local to the driver, which alone switches versions.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def path(self, version: str) -> str:
        return os.path.join(self.folder, f"v={version}")

    def write(self, version: str, tables: dict[str, DataFrame], meta: dict) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(os.path.join(self.path(version), name))
        with open(os.path.join(self.path(version), "meta.json"), "w") as f:
            json.dump({"normalization_version": VERSION, **meta}, f)

    def problems(self, spark: SparkSession, version: str) -> list[str]:
        with open(os.path.join(self.path(version), "meta.json")) as f:
            meta = json.load(f)
        out = [] if meta.get("normalization_version") == VERSION else ["normalization version"]
        if spark.read.parquet(os.path.join(self.path(version), "products")).count() != meta.get("count"):
            out.append("count")
        return out

    def _pointer(self) -> dict:
        try:
            with open(os.path.join(self.folder, "current.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    @property
    def current(self) -> str | None:
        return self._pointer().get("current")

    def switch(self, version: str) -> None:
        """Make a version live; the one before stays for ``rollback``."""
        self._put({"current": version, "previous": self.current})

    def rollback(self) -> None:
        """Exchange the live version and the one before it."""
        p = self._pointer()
        if not p.get("previous"):
            raise ValueError("there's no version to go back to")
        self._put({"current": p["previous"], "previous": p["current"]})

    def _put(self, pointer: dict) -> None:
        temp = os.path.join(self.folder, ".current.json")
        with open(temp, "w") as f:
            json.dump(pointer, f)
        os.replace(temp, os.path.join(self.folder, "current.json"))

    @contextmanager
    def lock(self):
        """Only one reload at a time; a second one is told so."""
        with open(os.path.join(self.folder, ".lock"), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise RuntimeError("busy") from None
            yield


def artifact_problems(synonyms: DataFrame, intents: DataFrame, token_df: DataFrame, products: int) -> list[str]:
    """VAL3: what is wrong with the files of a bundle: groups of fewer than two terms, intents without a target, word counts beyond the products."""
    found = []
    if not synonyms.where(F.coalesce(F.size("terms"), F.lit(0)) < 2).isEmpty():
        found.append("synonyms: a group of fewer than two terms")
    if not intents.where((F.coalesce(F.size("categories"), F.lit(0)) + F.coalesce(F.size("tags"), F.lit(0))) < 1).isEmpty():
        found.append("intents: a term without category or tag")
    if not token_df.where((F.col("df") < 1) | (F.col("df") > products)).isEmpty():
        found.append("token_df: a count out of range")
    return found
