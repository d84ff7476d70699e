"""The log's online checks as Structured Streaming: windows with watermarks, and per-key state.

Batch twins are in ``operators.logs`` and ``operators.calls``. Flags depend on what came before, so
within a micro-batch the rows of a key go by time and id; rows of a later batch come after all of an
earlier one. Window queries append: rows later than the watermark are dropped, which the batch forms
don't do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.shipping import ship
from ..operators.logs import BURST_ROWS, BURST_SECONDS, DUPLICATE_SECONDS, REPEAT_SECONDS, masked

WATERMARK = "10 minutes"


def counts(stream: DataFrame, length: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Searches and zero results of each tumbling window."""
    rows = stream.withWatermark("ts", watermark).groupBy(F.window("ts", length))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result_count") == 0).alias("zero")).select(F.col("window.start").alias("start"), "n", "zero")


def incidents(stream: DataFrame, gap: str = "60 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Failed calls within ``gap`` of each other as one session."""
    failed = stream.where(~F.col("outcome").isin("ok", "not_configured", "skipped")).withWatermark("ts", watermark)
    return failed.groupBy(F.session_window("ts", gap)).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n")).select("start", "end", "n")


KEEP, LATE = 20, "1 day"
WITHIN, SKEW = "1 HOUR", "5 SECONDS"  # a search before its events, and clocks


def _flagged(stream: DataFrame, keys: list[str], name: str, remember: int, seconds: int, test) -> DataFrame:
    """``stream`` with a boolean from the times (microseconds) of the last ``remember`` rows of the same key.

    A key is forgotten once the watermark is ``KEEP`` windows of ``seconds`` beyond its last row. Rows that
    come more than ``LATE`` after newer ones are dropped, as behind any watermark.
    """
    ship(stream.sparkSession)
    columns = stream.columns

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        flags = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            flags.append(bool(test(key, times, t)))
            times = [*times, int(t)][-remember:]
        state.update((times,))
        if times:
            state.setTimeoutTimestamp(max(times[-1] // 1000 + KEEP * seconds * 1000, state.getCurrentWatermarkMs() + 1000))
        yield rows[columns].assign(**{name: flags})

    schema = StructType([*stream.schema.fields, StructField(name, BooleanType())])
    return stream.withWatermark("ts", LATE).groupBy(*keys).applyInPandasWithState(run, schema, "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def flag_duplicates(stream: DataFrame, seconds: int = DUPLICATE_SECONDS) -> DataFrame:
    """is_duplicate, as the batch form."""
    return _flagged(stream, ["session_id", "normalized_q", "page"], "is_duplicate", 1, seconds, lambda key, times, t: not pd.isna(key[0]) and times and t - times[-1] <= seconds * 1_000_000)


def flag_bursts(stream: DataFrame, seconds: int = BURST_SECONDS, rows: int = BURST_ROWS) -> DataFrame:
    """is_burst of first pages, as the batch form."""
    return _flagged(stream, ["session_id", "normalized_q", "page"], "is_burst", rows, seconds, lambda key, times, t: key[2] == 1 and len(times) >= rows and t - times[0] <= seconds * 1_000_000)


def dedupe_events(stream: DataFrame, logs: DataFrame, seconds: int = REPEAT_SECONDS) -> DataFrame:
    """S3: events of known searches, without repeats shortly after the same one. ``logs`` may be static."""
    known = stream.where(F.col("action").isin("click", "dym_click")).join(logs.select("search_uuid").distinct(), "search_uuid", "left_semi").select(*stream.columns)
    flagged = _flagged(known, ["search_uuid", "product_id", "action"], "repeated", 1, seconds, lambda key, times, t: times and t - times[-1] <= seconds * 1_000_000)
    return flagged.where(~F.col("repeated")).drop("repeated")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Recent(StatefulProcessor):
    """Remembers the times of a key's last ``most`` rows that count, and forgets them by a timer ``micros`` after the last.

    A row's answer goes on at once: whether ``most`` rows that count lie within ``micros`` before it; with
    ``itself`` it is one of them. Rows of one time are answered before any of them counts for the others.
    """

    def __init__(self, columns: list[str], name: str, most: int, micros: int, counts: str | None, itself: bool):
        self.columns, self.name, self.most, self.micros, self.counts, self.itself = columns, name, most, micros, counts, itself

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "at array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["ts", "id"])
        at = rows["ts"].astype("datetime64[us]").astype("int64").tolist()
        counts = [True] * len(rows) if self.counts is None else rows[self.counts].fillna(False).astype(bool).tolist()
        times = list(self.times.get()[0]) if self.times.exists() else []
        flags, i = [], 0
        while i < len(at):
            j = i
            while j < len(at) and at[j] == at[i]:
                j += 1
            now = [at[i]] * sum(counts[i:j])
            seen = times + now if self.itself else times
            enough = len(seen) >= self.most and at[i] - seen[-self.most] <= self.micros
            flags += [enough] * (j - i)
            times, i = (times + now)[-self.most :], j
        if times:
            self.times.update((times,))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(times[-1] + self.micros, 0) // 1000 + 1)
        yield rows[self.columns].assign(**{self.name: flags})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def _recent(stream: DataFrame, key: str, name: str, most: int, seconds: int, counts: str | None, itself: bool) -> DataFrame:
    ship(stream.sparkSession)
    stream.sparkSession.conf.set(STORE, ROCKS)  # the only store with timers
    schema = StructType([*stream.schema.fields, StructField(name, BooleanType())])
    processor = _Recent(stream.columns, name, most, seconds * 1_000_000, counts, itself)
    return stream.withWatermark("ts", LATE).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def throttled(attempts: DataFrame, most: int = 5, minutes: int = 15) -> DataFrame:
    """``attempts`` (id, ts, who, failed) with whether the sign-in is refused, as the batch form; each answered as it comes."""
    return _recent(attempts, "who", "throttled", most, minutes * 60, "failed", False)


def cache_lifetime(lookups: DataFrame, hot: int = 20, days: int = 7) -> DataFrame:
    """``lookups`` (id, ts, key, empty) with ttl, the seconds that the answer lives, as the batch form; each answered as it comes."""
    rows = _recent(lookups, "key", "is_hot", hot, days * 86400, None, True)
    return rows.withColumn("ttl", F.when(F.col("empty"), 300).when(F.col("is_hot"), 7 * 86400).otherwise(86400)).drop("is_hot")


def matched_events(events: DataFrame, logs: DataFrame, within: str = WITHIN, watermark: str = WATERMARK) -> DataFrame:
    """S3 with both sides as streams: ``events`` with status ``known``, ``unknown`` or ``invalid``.

    An event is known if its search came within ``within`` before it, or after it by what clocks may be
    off (``SKEW``). Both sides have watermarks and the times are bounded, so neither is remembered for
    longer than that; an event whose search doesn't come is unknown once the watermark has passed it.
    Of an event that isn't a valid one nothing is remembered.
    """
    sound = F.col("search_uuid").isNotNull() & F.col("action").isin("click", "dym_click") & (F.col("position") >= 0) & ((F.col("action") == "dym_click") | (F.col("product_id") >= 1))
    sound = F.coalesce(sound, F.lit(False))
    columns = events.columns
    asked = logs.select(F.col("search_uuid").alias("known_uuid"), F.col("ts").alias("searched")).withWatermark("searched", watermark)
    met = events.where(sound).withWatermark("ts", watermark).join(
        asked, F.expr(f"search_uuid = known_uuid AND searched >= ts - INTERVAL {within} AND searched <= ts + INTERVAL {SKEW}"), "left_outer"
    )
    known = F.when(F.col("known_uuid").isNull(), "unknown").otherwise("known")
    return met.select(*columns, known.alias("status")).unionByName(events.where(~sound).withColumn("status", F.lit("invalid")))


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Masked rows appended as parquet, exactly once."""
    return masked(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
