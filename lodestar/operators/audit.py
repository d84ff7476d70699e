"""Sign-ins, audit trail and guarded edits."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def failed_logins(audit: DataFrame, now, minutes: int = 15) -> DataFrame:
    """AGG35: (who, failures, last) of failed sign-ins within the window that ends at ``now``."""
    end = F.lit(now).cast("timestamp")
    inside = audit.where((F.col("action") == "login_failed") & (F.col("ts") <= end) & (F.col("ts") > end - F.make_interval(mins=F.lit(minutes))))
    return inside.groupBy("who").agg(F.count(F.lit(1)).alias("failures"), F.max("ts").alias("last"))


def throttled(attempts: DataFrame, most: int = 5, minutes: int = 15) -> DataFrame:
    """``attempts`` (id, ts, who, failed) with whether ``most`` failures of the same one lie in the window before each."""
    micros = F.unix_micros("ts")
    before = Window.partitionBy("who").orderBy(micros).rangeBetween(-minutes * 60_000_000, -1)
    return attempts.withColumn("throttled", F.count_if("failed").over(before) >= most)


def recent(audit: DataFrame, rows: int = 50, actions: list[str] | None = None) -> DataFrame:
    """L3: the newest entries, of some actions or all."""
    some = audit.where(F.col("action").isin(actions)) if actions is not None else audit
    return some.orderBy(F.desc("ts"), F.desc("id")).limit(rows)


def latest_per_action(audit: DataFrame) -> DataFrame:
    """L3: (action, last) of every action."""
    return audit.groupBy("action").agg(F.max("ts").alias("last"))


def version_of(rows: DataFrame) -> str:
    """VAL8: a hash of the rows' contents, in any order; what an edit names as the state that it started from."""
    every = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    total = rows.select(F.sum(F.conv(F.substring(every, 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{total.s}:{total.n}".encode()).hexdigest()


class Stale(Exception):
    """The table has changed since the edit was begun."""


def guarded(current: DataFrame, expected: str) -> DataFrame:
    """VAL8: ``current``, if it's still of the version ``expected``."""
    if version_of(current) != expected:
        raise Stale(expected)
    return current
