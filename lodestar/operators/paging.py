"""Pages of the search log: views with search, sort and scan limit, and the raw export page by page.

For the export the log is stored once in files of neighbouring keys, newest first. One row a file holds
its smallest and largest key, so that a page opens the files that it needs and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import numbered
from .lexicon import kept

#: The columns that may be shown or sorted by, and exported, in order.
SORTS = ("ts", "raw_q", "normalized_q", "tier", "had_vector", "result_count", "top_ids", "latency_ms", "did_you_mean", "customer_id", "cache_hit", "id")
TEXTS = ("raw_q", "normalized_q", "tier", "top_ids", "did_you_mean", "customer_id")
EXPORTED = ("ts", "raw_q", "normalized_q", "had_vector", "result_count", "latency_ms", "did_you_mean", "tier", "cache_hit")
VIEWS = ("recent", "zero", "slowest")
PAGE, LONGEST_TERM, MOST_ROWS = 2000, 100, 500


def log_view(logs: DataFrame, view: str = "recent", sort: str = "", direction: str = "", term: str = "", scan: int = 0) -> tuple[DataFrame, list[Column]]:
    """The rows of a view and their order.

    Unknown views are ``recent``; a sort that isn't allowed or there takes its direction with it. Texts
    sort from A, all else from the largest; nulls are smallest; ties go by id. A term is looked for in
    both query columns, whatever its case. With ``scan``, a search or a sort only reads that many ids
    from the newest: the service's own limit, off by default.
    """
    view = view if view in VIEWS else "recent"
    if sort not in SORTS or sort not in logs.columns:
        sort, direction = ("latency_ms" if view == "slowest" else "id"), ""
    up = direction == "asc" or (direction != "desc" and sort in TEXTS)
    term = term[:LONGEST_TERM].strip().lower()
    rows = logs.where("result_count = 0") if view == "zero" else logs
    if term:
        rows = rows.where(F.contains(F.lower("raw_q"), F.lit(term)) | F.contains(F.lower("normalized_q"), F.lit(term)))
    if scan > 0 and (term or sort not in ("id", "ts")):
        rows = rows.where(F.col("id") > logs.agg(F.max("id")).scalar() - scan)
    by = (lambda c: F.asc_nulls_first(c)) if up else (lambda c: F.desc_nulls_last(c))
    return rows, [by(sort)] if sort == "id" else [by(sort), by("id")]


def log_page(logs: DataFrame, page: int = 1, per: int = 50, **view) -> DataFrame:
    """The rows of one page with ``place``, from 1 over all pages; none beyond the last. See ``log_view``."""
    rows, order = log_view(logs, **view)
    per = min(MOST_ROWS, max(1, per))
    first = (max(1, page) - 1) * per
    some = rows.orderBy(*order).limit(first + per)  # as many as were paged through
    return kept(numbered(some, "place", *order), "page").where(F.col("place") >= first).withColumn("place", F.col("place") + 1)


@dataclass
class Pages:
    """A log stored by descending id: its rows, and (file, newest, oldest, n) of each file."""

    rows: DataFrame
    files: DataFrame

    def page(self, after: int | None = None, size: int = PAGE, keep: Column | None = None) -> DataFrame:
        """SNK5, W11: the ``size`` newest rows with an id below ``after`` that pass ``keep``: id and the exported columns that there are.

        Files are opened from the newest that may hold one, twice as many each time as rows are missing.
        """
        below = F.lit(True) if after is None else F.col("oldest") < after
        files = [r.file for r in self.files.where(below).orderBy(F.desc("newest"), "file").select("file").collect()]  # a row a file
        names = ["id", *(c for c in EXPORTED if c in self.rows.columns)]
        rows = self.rows if after is None else self.rows.where(F.col("id") < after)
        rows = rows if keep is None else rows.where(keep)
        opened = 1
        while True:
            some = self._of(rows, files[:opened]).orderBy(F.desc("id")).limit(size).select(names)
            if opened >= len(files) or some.count() >= size:
                return some
            opened *= 2

    def _of(self, rows: DataFrame, files: list[str]) -> DataFrame:
        # the names prune the scan to these files
        return rows.where(F.col("_metadata.file_path").isin(files)) if files else rows.limit(0)

    def export(self, limit: int | None = None, keep: Column | None = None, size: int = PAGE) -> DataFrame:
        """All rows that pass ``keep``, or the ``limit`` newest: page and place from 0, id and the exported columns, whatever their number, without a sort in one task."""
        names = ["id", *(c for c in EXPORTED if c in self.rows.columns)]
        placed = numbered((self.rows if keep is None else self.rows.where(keep)).select(names), "place", F.desc("id"))
        placed = placed if limit is None else placed.where(F.col("place") < limit)
        return placed.select(F.floor(F.col("place") / size).alias("page"), "place", *names)


def clustered(logs: DataFrame, rows_a_file: int = 100_000) -> Pages:
    """Stores the log by descending id, in files of about ``rows_a_file`` rows."""
    parts = max(1, -(-logs.count() // rows_a_file))
    rows = kept(logs.repartitionByRange(parts, F.desc("id")).sortWithinPartitions(F.desc("id")), "log-pages")
    each = rows.select("id", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.max("id").alias("newest"), F.min("id").alias("oldest"), F.count(F.lit(1)).alias("n"))
    return Pages(rows, kept(each, "log-files"))
