r"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the identifiers that four patterns find anywhere. Every token group with a digit or an at
sign is an *instance*; its *patterns* are the two words before it, the word before or after it with
the shape of its value, and the shapes of both neighbours and its value. Patterns and instances form a
bipartite graph that is scored in rounds: a pattern is as good as the mean confidence of the distinct
instances it introduces, and all that reach ``PRECISION`` and ``SUPPORT`` are promoted: they pass
confidence on to the other instances they introduce. Rounds go on until no more are promoted. Instances that no seed pattern matched, but
that have a promoted pattern and the loose shape of its kind, are reported too.

The patterns below find what their plain forms find, but run in linear time: a match can only start
at the start of a run (or where the match before ended), and runs aren't given back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, ref, stored, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a pattern can't match.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: What an unseen identifier of a kind has to look like. What a seed pattern matches but its test refuses isn't one.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^(?![0-9]+(?:\.[0-9]+){3}$)[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{1,4}){3,7}$",
    "card": r"^[0-9](?:[\x20-]?[0-9]){11,12}$",
    "phone": r"^\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,10}$",
}
INSTANCE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
PRECISION, SUPPORT = 0.8, 3
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, left, value, right>> of all matches, with the texts up to the next ones; positions in code points."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(between, F.lit(1), F.size(values)).alias("left"), values.alias("value"), F.slice(between, F.lit(2), F.size(values)).alias("right"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["left"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["left"].alias("left"), x["value"].alias("value"), x["right"].alias("right"))).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,left:string,value:string,right:string>>")
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    number = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, number(i)).otherwise(twice(number(i))))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        # without leading zeros, so that a part of any length fits an int
        short = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.concat(F.lit("0"), F.substring(p, 1, 4)).cast("int") <= 255))
    size = F.length(_digits(value))
    if kind == "card":
        return (size >= 14) & (size <= 19) & _luhn(_digits(value))
    if kind == "phone":
        return (size >= 10) & (size <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the seeds in a text, by start, then kind as listed."""

    def of(i: int, kind: str) -> Column:
        guard = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GUARDS[kind])
        good = F.filter(_matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
        return F.when(guard, _as_spans(good, i)).otherwise(F.array().cast(SPANS))

    return F.array_sort(F.concat(*(of(i, kind) for i, kind in enumerate(KINDS))))


def _as_spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _shape(text: Column) -> Column:
    """Runs of digits as 9, of lower-case letters as a, of other letters as A."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "9"), r"\p{Ll}+", "a"), r"[\p{L}&&[^a]]+", "A")


def _instances(text: Column, spans: Column) -> Column:
    """array<struct<patterns, value, start, end, kinds>>; kinds are those of the seeds that it touches.

    The start of a text counts as the word ^, its end as $, another instance as #.
    """
    words = lambda t: F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda x: x != "")

    def one(m: Column, i: Column, n: Column) -> Column:
        lead = F.length(F.regexp_extract(m["value"], r"^[^\p{L}\p{N}+(@]*+", 0))
        value = F.regexp_replace(F.substring(m["value"], lead + 1, F.length(m["value"])), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        before = F.concat(F.array(F.when(i == 0, "^").otherwise("#")), words(m["left"]))
        after = F.concat(words(m["right"]), F.array(F.when(i == n - 1, "$").otherwise("#")))
        left, right, shape = F.element_at(before, -1), F.get(after, F.lit(0)), _shape(value)
        patterns = F.array(
            F.concat(F.lit("2 "), F.lower(F.array_join(F.slice(before, -F.least(F.size(before), F.lit(2)), 2), " "))), F.concat_ws(" ", F.lit("l"), F.lower(left), shape),
            F.concat_ws(" ", F.lit("r"), shape, F.lower(right)), F.concat_ws(" ", F.lit("s"), _shape(left), shape, _shape(right)),
        )
        touching = F.filter(spans, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"]))
        start = m["start"] + lead
        return F.struct(patterns.alias("patterns"), value.alias("value"), start.alias("start"), (start + F.length(value)).alias("end"), F.array_distinct(F.transform(touching, lambda s: s["kind"])).alias("kinds"))

    none = F.array().cast("array<struct<patterns:array<string>,value:string,start:int,end:int,kinds:array<int>>>")
    # one name for all matches, so that they are found once
    with_all = F.transform(F.array(_matches(text, INSTANCE)), lambda all_: F.transform(all_, lambda m, i: one(m, i, F.size(all_))))
    return F.when(text.rlike("[0-9@]"), F.get(with_all, F.lit(0))).otherwise(none)


def _fits(kind: Column, value: Column) -> Column:
    return reduce(lambda a, b: a | b, ((kind == i) & value.rlike(SHAPES[k]) for i, k in enumerate(KINDS)))


def promoted_patterns(instances: DataFrame) -> DataFrame:
    """Stored: pattern, kind, precision of all of high confidence. ``instances``: stored rows (patterns, value, kinds)."""
    edges = stored(instances.select(F.explode("patterns").alias("pattern"), "value").distinct(), "pii-graph")
    # what a seed pattern found stays known for sure, whatever patterns pass on
    seeds = stored(instances.select("value", F.explode("kinds").alias("kind")).distinct().withColumn("confidence", F.lit(1.0)), "pii-seeds")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= SUPPORT)
    edges = stored(edges.join(sizes, "pattern"), "pii-graph")
    free = stored(edges.join(seeds.select("value").distinct(), "value", "left_anti").select("pattern", "value"), "pii-free")
    known, best = seeds, instances.sparkSession.createDataFrame([], "pattern string, kind int, precision double")
    while True:
        support = edges.join(known, "value").groupBy("pattern", "kind", "values").agg(F.sum("confidence").alias("mass"), F.count(F.lit(1)).alias("support"))
        scored = support.withColumn("precision", F.round(F.col("mass") / F.col("values"), 9)).where((F.col("support") >= SUPPORT) & (F.col("precision") >= PRECISION))
        new = stored(scored.select("pattern", "kind", "precision").join(best.select("pattern", "kind"), ["pattern", "kind"], "left_anti"), "pii-promoted")
        if new.isEmpty():
            return best
        best = stored(best.unionByName(new), "pii-promoted")
        passed = free.join(best, "pattern").where(_fits(F.col("kind"), F.col("value")))
        passed = passed.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("precision"), F.lit(0.99)))))).alias("confidence"))
        known = seeds.unionByName(stored(passed, "pii-known"))


def _extra_spans(scanned: DataFrame) -> DataFrame:
    """Stored: key, extra (spans) of the rows of ``scanned`` with unseen identifiers that have promoted patterns."""
    instances = scanned.select("key", F.inline("instances"))
    patterns = promoted_patterns(instances.select("patterns", "value", "kinds"))
    free = instances.where(F.size("kinds") == 0).select("key", "value", "start", "end", F.explode("patterns").alias("pattern"))
    found = free.join(patterns.select("pattern", "kind"), "pattern").where(_fits(F.col("kind"), F.col("value")))
    return stored(found.groupBy("key").agg(F.collect_set(F.struct("start", "kind", "end")).cast(SPANS).alias("extra")), "pii-extra")


def _all_spans(base: Column, extra: Column) -> Column:
    return F.array_sort(F.concat(base, F.coalesce(extra, F.array().cast(SPANS))))


def _kind(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), index + 1)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str, text_col: str, key: Column) -> DataFrame:
    """Stored, without the texts: id, key, base (spans), instances."""
    rows = docs.select(ref(id_col).alias("id"), key.alias("key"), F.coalesce(ref(text_col), F.lit("")).alias("t"))
    rows = rows.select("id", "key", "t", base_spans(F.col("t")).alias("base"))
    return stored(rows.select("id", "key", "base", _instances(F.col("t"), F.col("base")).alias("instances")), "pii-scan")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (array<struct<start, kind, end>>) of every row; base spans are among spans.

    Null texts are empty: no spans. Rows with null or equal ids stay rows of their own; an empty table
    gives none. Very common patterns weigh as one node of the graph: only distinct (pattern, value)
    pairs count.
    """
    scanned = scan(docs, id_col, text_col, F.monotonically_increasing_id())
    found = scanned.select("id", "key", "base").join(_extra_spans(scanned), "key", "left")
    return found.select(F.col("id").alias("doc_id"), "base", _all_spans(F.col("base"), F.col("extra")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; null texts stay null."""
    key, base, extra, spans = fresh(docs, "key", "base", "extra", "spans")
    text = ref(text_col)
    digest = F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))  # equal texts have equal spans
    more = _extra_spans(scan(docs, id_col, text_col, digest)).toDF(key, extra)
    work = docs.withColumn(base, base_spans(F.coalesce(text, F.lit("")))).withColumn(key, digest).join(more, key, "left")
    work = work.withColumn(spans, _all_spans(F.col(base), F.col(extra)))

    def step(acc: Column, s: Column) -> Column:
        # a span inside or across the one before it is covered by it up to there
        fromat = F.greatest(acc["at"], s["start"])
        piece = F.concat(F.substring(text, acc["at"] + 1, fromat - acc["at"]), F.concat(F.lit("["), F.upper(_kind(s["kind"])), F.lit("]")))
        new = F.struct(F.array_append(acc["out"], piece).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(new)

    folded = F.aggregate(F.col(spans), F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    clean = F.when(F.size(F.col(spans)) > 0, folded).otherwise(text)
    return work.select([clean.alias(c) if c == text_col else ref(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every whole text of ``documents``."""
    found = pii_spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
