r"""Audit of how sources of a language differ in their words.

1. A count-min sketch of document frequencies: every slice of documents adds up its (lang, term) pairs
   before they are hashed, partitions are merged by sums. The counters lie in blocks, so that all
   ``ROWS`` counters of a term are in one, each in its own row of it. A counter is never less than the
   document frequency of any of its terms.
2. Of the merged sketch only a bit a counter, whether it reaches ``LEAST`` documents, goes to the
   tasks. Terms that miss one of theirs can't be kept and are dropped before anything shuffles; the
   survivors are counted exactly.
3. Smoothed shares of all kept terms are compared between the sources of a language. Only terms that
   both sources hold are joined: what the others add follows from sums, since an absent term has one
   share in a source, its least.

Terms are runs of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]``, with A-Z in lower case.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import map_arrow, ref, stored, table

LEAST = 30  # documents of its language that hold a kept term
TOP = 50
HELD = 700_000  # counts that a task adds up before it hands them on
SMOOTHING, SCALE = 5, 1_000_000_000
ROWS, WIDTH = 2, 16_384  # of the sketch, and the counters of a row within a block
#: Counters of a row, for each document: the sketch is wider than the terms are many, as long as it
#: stays within ``MAX_BLOCKS`` lists of 4 KiB of bits (32 MiB). A fuller one only drops less.
PER_DOCUMENT, MAX_BLOCKS = 16, 8192
WORDS = ROWS * WIDTH // 64  # of the bits of a block

#: Bytes of a term as they are, with A-Z in lower case; all others as spaces.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(_TERM_BYTES).split()


def _counted(docs: DataFrame, exact: bool) -> DataFrame:
    """(lang, source, term, documents, occurrences), added up over as many documents of a task as bring ``HELD`` rows; without ``exact`` all sources are ''."""

    def rows(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (documents, occurrences) in groups.items():
            n = len(documents)
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(documents.keys(), pa.binary()).cast(pa.string()), pa.array(documents.values(), pa.int64())]
            columns.append(pa.array([occurrences[t] for t in documents] if exact else [0] * n, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "documents", "occurrences"])
        groups.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                documents, occurrences = groups.setdefault((lang, source if exact else ""), (Counter(), Counter()))
                terms = terms_of(text)
                documents.update(set(terms))
                if exact:
                    occurrences.update(terms)
            if sum(len(documents) for documents, _ in groups.values()) > HELD:
                yield from rows(groups)
        yield from rows(groups)

    return map_arrow(docs.select("lang", "source", "text"), run, "lang string, source string, term string, documents long, occurrences long")


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int")


def _counters() -> list[Column]:
    """The places of a term's counters within its block, one in each row."""
    return [(F.lit(i * WIDTH) + F.pmod(F.xxhash64("lang", "term", F.lit(i)), F.lit(WIDTH))).cast("int") for i in range(ROWS)]


def sketch(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, counter, n): the merged counters, those of 0 left out. ``docs``: lang, source and text without nulls."""
    each = _counted(docs, exact=False).select(_block(blocks).alias("block"), F.explode(F.array(*_counters())).alias("counter"), "documents")
    return each.groupBy("block", "counter").agg(F.sum("documents").alias("n"))


def _possible(rows: DataFrame, counters: DataFrame, blocks: int, least: int) -> DataFrame:
    """The rows whose term reaches ``least`` documents by all its counters."""
    reached = counters.where(F.col("n") >= least).groupBy("block", F.shiftright("counter", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, counter & 63)")).alias("bits"))
    words = reached.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))  # WORDS at most
    bits = words.select("block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("words", i), F.lit(0).cast("long"))).alias("bits"))
    # stored, so that its true size, at most MAX_BLOCKS rows of 4 KiB, is known before it's sent around
    met = rows.withColumn("block", _block(blocks)).join(F.broadcast(stored(bits, "sketch-bits")), "block")
    met = met.select(*rows.columns, "bits", *(c.alias(f"c{i}") for i, c in enumerate(_counters())))
    for i in range(ROWS):
        met = met.where(f"(shiftright(bits[shiftright(c{i}, 6)], c{i} & 63) & 1) = 1")
    return met.select(*rows.columns)


def term_counts(docs: DataFrame, least: int = LEAST, blocks: int | None = None) -> DataFrame:
    """Stored: (lang, source, term, n) of every term that ``least`` documents of its language hold; n occurrences there.

    ``docs``: lang, source and text without nulls.
    """
    blocks = blocks or min(MAX_BLOCKS, max(1, -(-docs.count() * PER_DOCUMENT // WIDTH)))
    counters = stored(sketch(docs, blocks), "sketch")
    some = _possible(_counted(docs, exact=True), counters, blocks, least)
    counts = stored(some.groupBy("lang", "source", "term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("n")), "survivors")
    kept = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least).select("lang", "term")
    return stored(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "term-counts")


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * kept)), exactly; 0 without kept terms."""
    return F.expr(f"if({kept} = 0, 0L, 1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTHING} as decimal(20,0))) div cast({total} + {SMOOTHING} * {kept} as decimal(20,0)))")


def _ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    return out if most is None else out.where(F.col("rank") <= most)


def _groups(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Stored: (lang, source, v, total, held, absent, mass): kept terms of the language, occurrences and kept terms here, share of an absent term, sum of all shares."""
    every = docs.select("lang", "source").distinct()
    v = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    rows = every.join(v, "lang", "left").join(own, ["lang", "source"], "left").fillna(0, ["v", "total", "held"])
    rows = stored(rows.withColumn("absent", _share("0", "total", "v")), "groups")
    shares = counts.join(rows.select("lang", "source", "total", "v"), ["lang", "source"]).groupBy("lang", "source").agg(F.sum(_share("n", "total", "v")).alias("present"))
    rows = rows.join(shares, ["lang", "source"], "left").withColumn("mass", F.coalesce("present", F.lit(0)) + (F.col("v") - F.col("held")) * F.col("absent"))
    return stored(rows.drop("present"), "group-masses")


def source_pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): the summed difference of shares of every two sources of a language, both ways.

    |x - y| is x + y - 2 min(x, y), and the sum of minima over all kept terms is that of the absent
    shares, plus what terms of one source add against the other's absent share, plus what shared terms
    add beyond that. Only the last needs a join of terms.
    """
    side = lambda x: groups.select("lang", F.col("source").alias(f"s{x}"), F.col("absent").alias(f"a{x}"), F.col("held").alias(f"h{x}"), F.col("mass").alias(f"m{x}"), *(["v"] if x == 1 else []))
    pairs = stored(side(1).join(side(2), "lang").where("s1 < s2"), "pairs")
    # the source with the lower absent share may hold terms with shares above it and below the other's
    lower = F.when(F.col("a1") <= F.col("a2"), F.col("s1")).otherwise(F.col("s2"))
    held = F.when(F.col("a1") <= F.col("a2"), F.col("h1")).otherwise(F.col("h2"))
    upper = F.greatest("a1", "a2")
    common = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    gaps = pairs.select("lang", "s1", "s2", lower.alias("source"), upper.alias("upper")).join(common, ["lang", "source"]).where("p < upper")
    gaps = gaps.groupBy("lang", "s1", "s2").agg(F.sum(F.col("terms") * (F.col("upper") - F.col("p"))).alias("gap"))
    one = lambda x: shares.select("lang", "term", F.col("source").alias(f"s{x}"), F.col("p").alias(f"p{x}"), F.col("absent").alias(f"a{x}"))
    least = lambda a, b: F.least(F.col(a), F.col(b))
    both = one(1).join(one(2), ["lang", "term"]).where("s1 < s2")
    both = both.groupBy("lang", "s1", "s2").agg(F.sum(least("p1", "p2") - least("p1", "a2") - least("a1", "p2") + least("a1", "a2")).alias("shared"))
    rows = pairs.join(gaps, ["lang", "s1", "s2"], "left").join(both, ["lang", "s1", "s2"], "left").fillna(0, ["gap", "shared"])
    minima = F.col("v") * least("a1", "a2") + held * F.abs(F.col("a1") - F.col("a2")) - F.col("gap") + F.col("shared")
    value = (F.col("m1") + F.col("m2") - 2 * minima).cast("long")
    ends = F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item")))
    return rows.select("lang", value.alias("value"), F.inline(ends)).select("lang", "source", "item", "value")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", blocks: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) that occurs.

    Part ``pair``: the other sources of the language by their difference. Part ``term``: terms held here
    whose share is above that of the language as a whole, the ``top`` with the largest difference.
    Nulls in any of the three columns count as ''; rows count as often as they come; other columns are
    ignored. A language with one source has no pairs, one without kept terms has differences of 0 and
    no terms. An empty table gives no rows.
    """
    text = lambda c: F.coalesce(ref(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counts = term_counts(rows, least, blocks)
    groups = _groups(rows, counts)
    shares = counts.join(groups.select("lang", "source", "total", "v", "absent"), ["lang", "source"])
    shares = stored(shares.select("lang", "source", "term", "absent", _share("n", "total", "v").alias("p")), "shares")
    pairs = _ranked(source_pairs(groups, shares)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    whole = whole.join(totals, "lang").select("lang", "term", _share("n", "total", "v").alias("q"))
    over = shares.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(_ranked(over, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of ``documents`` differ within their languages: lang, source, part, item, value, rank."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(max(v), 0) AS v, coalesce(sum(c), 0)::hugeint AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, 1 + ({SCALE}::hugeint * (coalesce(c, 0) + {SMOOTHING})) // (n + {SMOOTHING} * v) AS p FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + ({SCALE}::hugeint * (sum(c) + {SMOOTHING})) // (max(n) + {SMOOTHING} * max(v)) AS q FROM p JOIN (SELECT lang, sum(n) AS n, max(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(sum(abs(a.p - b.p)), 0)::bigint AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN p a ON a.lang = x.lang AND a.source = x.source LEFT JOIN p b ON b.lang = y.lang AND b.source = y.source AND b.term = a.term GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q)::bigint AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, cast(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS int) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, value, cast(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS int) AS rank FROM terms QUALIFY rank <= {TOP}
"""
