"""SQL dumps read by byte ranges, however long a statement is: many tasks read one file.

Outside of strings a closing parenthesis ends a list of columns or a row. Spark reads the file cut at
all of them, range by range; which ones are inside strings is known from the quotes before: an odd
number means inside. Each range counts its quotes, and how many units it ends with either parity at its
start; prefix sums over the ranges, one row each, give each one's parity and its first unit's number.
Units that lie within a range are parsed there. Those across borders, two pieces a range, are put
together by number. A row without its list in sight takes the columns of the last list before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..operators.lexicon import kept

END = ")"
_LIST = re.compile(r"INSERT\s+INTO\s+[^\s(]+\s*\(([^)]*)\)\Z", re.IGNORECASE)
_PLAIN = re.compile(r"INSERT\s+INTO\s+[^\s(]+\s*VALUES\s*\(", re.IGNORECASE)
_START = re.compile(r"\A(?:[\s,;]|VALUES)*\(", re.IGNORECASE)
_VALUE = re.compile(r"\s*(?:'((?:[^']|'')*)'|([^',()\s][^',()]*)?)\s*([,)])")
_PARSED = "file string, range long, unit long, kind string, items array<string>"


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, text): the text up to each closing parenthesis, range by range in order."""
    lines = spark.read.option("lineSep", END).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").alias("text"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, range), text) of the rows of a task, in which those of a range follow each other."""
    for b in batches:
        yield from zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, range, quotes, ends0, ends1): units that end in a range if it starts outside, or inside, of a string."""
    counts: dict[tuple[str, int], list[int]] = {}
    for key, text in _by_range(batches):
        c = counts.setdefault(key, [0, 0, 0])
        c[0] += text.count("'")
        c[1 + c[0] % 2] += 1
    rows = [(*k, *c) for k, c in counts.items()]
    yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("file", pa.string()), ("range", pa.int64()), ("quotes", pa.int64()), ("ends0", pa.int64()), ("ends1", pa.int64())))})


def row_values(text: str, at: int) -> list[str | None]:
    """The values from behind an opening parenthesis to the closing one; NULL and nothing are None."""
    row: list[str | None] = []
    while v := _VALUE.match(text, at):
        bare = (v[2] or "").strip()
        row.append(v[1].replace("''", "'") if v[1] is not None else None if bare.upper() in ("NULL", "") else bare)
        at = v.end()
        if v[3] == END:
            return row
    raise ValueError(f"no value at: {text[at : at + 40]!r}")


def unit(text: str) -> tuple[str, list[str | None] | None]:
    """What a unit is: ``list`` with its columns, ``row`` with its values, ``plain`` with those of a row whose statement names no columns, or ``other``."""
    if m := _PLAIN.search(text):
        return "plain", row_values(text, m.end())
    if m := _LIST.search(text):
        return "list", [c.strip().strip("`") for c in m[1].split(",")]
    if m := _START.match(text):
        return "row", row_values(text, m.end())
    return "other", None


def _parser(starts: dict[tuple[str, int], tuple[int, int]]):
    """Gives the units of a task's ranges; a range's first and last unit may be pieces, of kind ``piece``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, odd, number, parts, first = None, 0, 0, [], True

        def piece() -> None:
            if key is not None and (text := "".join(parts)):
                out.append((*key, number, "piece", [text]))

        for k, text in _by_range(batches):
            if k != key:
                piece()
                key, parts, first = k, [], True
                odd, number = starts[k]
            odd = (odd + text.count("'")) % 2
            parts.append(text + END)
            if not odd:
                whole = "".join(parts)
                out.append((*key, number, "piece", [whole]) if first else (*key, number, *unit(whole)))
                parts, first, number = [], False, number + 1
            if len(out) >= 5000:
                yield _batch(out)
                out.clear()
        piece()
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (("file", pa.string()), ("range", pa.int64()), ("unit", pa.int64()), ("kind", pa.string()), ("items", pa.list_(pa.string())))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole = [unit(t) for t in b.column(3).to_pylist()]
        yield _batch([(f, r, u, *w) for f, r, u, w in zip(*(b.column(i).to_pylist() for i in range(3)), whole)])


def read_dump(spark: SparkSession, path: str, default: list[str]) -> DataFrame:
    """The columns ``default`` of all rows of a dump, with file and unit (its place in the file).

    Quotes are doubled inside strings, a backslash is a backslash, NULL is null, all values are text.
    Statements without a list of columns have those of ``default``. A row of another number of values,
    or without one of the columns, is an error; so is a file that ends inside a row.
    """
    ship(spark)
    parts = segments(spark, path)
    counts = kept(parts.mapInArrow(_counted, "file string, range long, quotes long, ends0 long, ends1 long"), "ranges")
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    odd = counts.withColumn("odd", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    odd = odd.withColumn("ends", F.when(F.col("odd") == 0, F.col("ends0")).otherwise(F.col("ends1")))
    rows = odd.select("file", "range", "odd", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("unit")).collect()  # a row a range of some 128 MB
    starts = {(r.file, r.range): (r.odd, r.unit) for r in rows}
    units = kept(parts.mapInArrow(_parser(starts), _PARSED), "units")
    pieces = units.where("kind = 'piece'").groupBy("file", "unit").agg(F.min("range").alias("range"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", F.col("items")[0].alias("t")))), lambda x: x["t"]), "").alias("text"))
    joined = kept(pieces.select("file", "range", "unit", "text").mapInArrow(_join_pieces, _PARSED), "joined")
    every = units.where("kind <> 'piece'").unionByName(joined)
    # the last list of columns before each range's own units, and before each unit that was put together
    named = F.when(F.col("kind") == "list", F.col("items")).otherwise(F.array(*map(F.lit, default)))
    lists = every.where("kind in ('list', 'plain')").groupBy("file", "range").agg(F.max_by(F.struct(named.alias("columns"), "unit"), "unit").alias("x")).select("file", F.col("x.unit").alias("unit"), F.lit(None).cast("long").alias("range"), F.col("x.columns").alias("columns"))
    border = joined.where("kind in ('list', 'plain')").select("file", "unit", F.lit(None).cast("long").alias("range"), named.alias("columns"))
    none = F.lit(None).cast("array<string>")
    asks = units.where("kind = 'row'").groupBy("file", "range").agg(F.min("unit").alias("unit")).select("file", "unit", "range", none.alias("columns"))
    asks = asks.unionByName(joined.where("kind = 'row'").select("file", "unit", (-F.col("unit") - 1).alias("range"), none.alias("columns")))
    order = Window.partitionBy("file").orderBy("unit", F.col("columns").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # a few rows a range
    known = lists.unionByName(border).unionByName(asks).withColumn("columns", F.last("columns", ignorenulls=True).over(order)).where("range is not null").select("file", "range", F.coalesce("columns", F.array(*map(F.lit, default))).alias("outer"))
    # within a range its own lists come first
    own = Window.partitionBy("file", "range").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
    inner = units.where("kind <> 'piece'").withColumn("own", F.last(F.when(F.col("kind").isin("list", "plain"), named), ignorenulls=True).over(own)).where("kind in ('row', 'plain')")
    across = joined.where("kind in ('row', 'plain')").withColumn("own", F.when(F.col("kind") == "plain", named)).withColumn("range", -F.col("unit") - 1)
    found = inner.unionByName(across).join(known, ["file", "range"], "left").withColumn("columns", F.coalesce("own", "outer"))
    bad = F.raise_error(F.format_string("a row of %d values for %d columns", F.size("items"), F.size("columns")))
    lacks = F.raise_error(F.lit("a row without one of the columns"))
    at = lambda c: F.array_position("columns", F.lit(c)).cast("int")
    value = lambda c: F.when(F.size("items") != F.size("columns"), bad).when(at(c) == 0, lacks).otherwise(F.get("items", at(c) - 1))
    return found.select("file", "unit", *(value(c).alias(c) for c in default))
