"""Catalog sources and sinks: CSV and SQL-text input, key-wise upsert, versioned bundles."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sniff_delimiter(header: str) -> str:
    """``;`` if the header line has more of it than of commas."""
    return ";" if header.count(";") > header.count(",") else ","


def read_csv(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """RFC 4180 with a header and line breaks inside quotes; every column is text."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    sep = sniff_delimiter(first.value) if first else ","
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def looks_truncated(spark: SparkSession, path: str, rows: DataFrame) -> bool:
    """More than ten lines start like rows, but a tenth of them weren't parsed."""
    lines = spark.read.text(path).agg(F.count_if(F.col("value").rlike(r"^\d+,"))).first()[0]
    return lines > 10 and rows.count() < 0.9 * lines


_INSERT = re.compile(r"INSERT\s+INTO\s+[^\s(]+\s*(?:\(([^)]*)\)\s*)?VALUES\s*", re.IGNORECASE)
_VALUE = re.compile(r"\s*(?:'((?:[^']|'')*)'|([^',()\s][^',()]*)?)\s*([,)])")


def insert_rows(text: str, default: list[str] | None = None) -> Iterator[dict[str, str | None]]:
    """The rows of INSERT statements by column: quotes are doubled inside strings, a backslash is a backslash, NULL is None, numbers are text.

    A statement without a list of columns has those of ``default``. A row of another number of values is an error.
    """
    at = 0
    while m := _INSERT.search(text, at):
        columns, at = [c.strip().strip("`") for c in m[1].split(",")] if m[1] is not None else default or [], m.end()
        while text[at : at + 1] == "(":
            at, row = at + 1, []
            while v := _VALUE.match(text, at):
                bare = (v[2] or "").strip()
                row.append(v[1].replace("''", "'") if v[1] is not None else None if bare.upper() in ("NULL", "") else bare)
                at = v.end()
                if v[3] == ")":
                    break
            else:
                raise ValueError(f"no value at character {at}")
            if len(row) != len(columns):
                raise ValueError(f"a row of {len(row)} values for {len(columns)} columns")
            yield dict(zip(columns, row))
            while text[at : at + 1] in (" ", "\t", "\r", "\n", ",") and at < len(text):
                at += 1


def read_inserts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of files of INSERT statements, all text; a row without one of them is an error. See ``dumps.read_dump``."""
    from .dumps import read_dump

    return read_dump(spark, path, columns).select(*(F.col(f"`{c}`") for c in columns))


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK1: RFC 4180 with a header; null is empty; quotes are doubled."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: the last row of each key by ``order`` wins."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(token, freq) of ``token<TAB>count`` lines; malformed ones are skipped."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where((F.size(parts) == 2) & parts[1].rlike(r"^\d+$") & (parts[0] != ""))
    return lines.select(parts[0].alias("token"), parts[1].cast("long").alias("freq"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(query, relevant, note) of a judgement CSV with comment lines; blank queries are dropped, ids distinct."""
    rows = read_csv(spark, path, comment="#").withColumnsRenamed({"﻿query": "query"})
    ids = F.transform(F.filter(F.split(F.coalesce("relevant_ids", F.lit("")), ";"), lambda x: F.trim(x).rlike(r"^\d+$")), lambda x: F.trim(x).cast("long"))
    note = F.col("note") if "note" in rows.columns else F.lit(None).cast("string")
    return rows.where(F.trim("query") != "").select(F.trim("query").alias("query"), F.array_distinct(ids).alias("relevant"), note.alias("note"))


def distinct_queries(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each non-empty key, in order."""
    w = Window.partitionBy("__k").orderBy(order)
    return rows.withColumn("__k", key).where("__k <> ''").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__k")
