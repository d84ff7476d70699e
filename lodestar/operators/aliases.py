"""Alias groups: checks before they're saved, counts of what they match, merging of generated candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize

LONGEST, SHORTEST, BROAD = 64, 3, 500


def problems(groups: DataFrame, counts: DataFrame | None = None, blocked: tuple[str, ...] = ()) -> DataFrame:
    """(group_id, term, level, problem) of alias groups (group_id, terms).

    Errors: an empty or too long term, the same term twice in a group, a group of less than two terms.
    Warnings: a term that another group has, a very short, a blocked one, one that matches very many products
    (``counts``: term, products).
    """
    terms = groups.select("group_id", F.posexplode_outer("terms").alias("at", "raw")).withColumn("term", normalize("raw"))
    within = terms.groupBy("group_id", "term").agg(F.count(F.lit(1)).alias("times"))
    elsewhere = terms.where("term <> ''").groupBy("term").agg(F.count_distinct("group_id").alias("groups"))
    sizes = terms.where("term <> ''").groupBy("group_id").agg(F.count_distinct("term").alias("size"))
    rows = within.join(elsewhere, "term", "left").join(sizes, "group_id", "left")
    if counts is not None:
        rows = rows.join(counts, "term", "left")
    length = F.length("term")
    tests = [
        ("error", "empty", length == 0), ("error", "too long", length > LONGEST), ("error", "duplicate", (F.col("times") > 1) & (length > 0)), ("error", "fewer than two terms", F.coalesce("size", F.lit(0)) < 2),
        ("warning", "in another group", F.col("groups") > 1), ("warning", "short", (length > 0) & (length < SHORTEST)),
        ("warning", "blocked", F.col("term").isin(*blocked) if blocked else F.lit(False)), ("warning", "broad", F.col("products") > BROAD if counts is not None else F.lit(False)),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("problem"))) for level, name, test in tests)))
    return rows.select("group_id", "term", F.inline(found))


def folded(candidates: list[list[str]], existing: list[list[str]]) -> list[list[str]]:
    """Generated groups folded, in their order, into the first group that shares a term. The order decides, so this is a loop over a small file."""
    out = [list(g) for g in existing]
    for terms in candidates:
        home = next((g for g in out if set(g) & set(terms)), None)
        if home is None:
            out.append(home := [])
        home.extend(t for t in dict.fromkeys(terms) if t not in home)
    return [g for g in out if len(g) > 1]


def alternatives(rows: DataFrame, most: int = 4) -> DataFrame:
    """(name, term): the usable spellings of each name: other than it, letters of one script, distinct once normalized, the first ``most``."""
    each = rows.select("name", F.posexplode("terms").alias("at", "raw")).withColumn("term", normalize("raw"))
    mixed = F.col("term").rlike("[a-z]") & F.col("term").rlike(r"[\x{0600}-\x{06FF}]")
    good = each.where((F.length("term").between(2, LONGEST)) & ~mixed & (F.col("term") != normalize("name")))
    first = good.groupBy("name", "term").agg(F.min("at").alias("at"))
    ordered = first.groupBy("name").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]), 1, most).alias("terms"))
    return ordered.select("name", F.explode("terms").alias("term"))
