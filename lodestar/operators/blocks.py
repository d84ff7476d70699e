"""Exact top hits through blocks of products, without scoring every product that holds a word.

Products are numbered by popularity, so that a block of ``1 << BITS`` numbers holds products of about
the same. For each word asked for and each block that it occurs in there's one row: a bitmap of its
products and the best that the word can add there. Then, for a batch of queries:

1. The bitmaps of a query's required words are intersected block by block (``bitmap_and_agg``). What
   is left are exactly the products that hold all of them; with ``omit``, all but one, for each choice
   of the one.
2. The sum of the words' best (without the one left out) gives each block a bound, comparable with the
   key that hits are ranked by. The blocks with the best bounds are opened until they hold ``k`` products; those are scored.
3. A block that wasn't opened is only opened if its bound reaches the key of the query's k-th hit.

Only products of opened blocks meet the postings of the query's words.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexicon import kept

BITS = 15  # a bitmap of Spark's has 32,768 bits
EVERY = b"\xff" * 4096
#: Which fields count for a query (``kind``): all, those other than the description, titles.
WHOLE, FIELDS, TITLES = 0, 1, 2
LONGEST_WHOLE = 3  # longer words asked for are met as prefixes


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with the column ``name``: their place, from 0, in an order over all of them; by a sort in ranges and prefix sums over these."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered = kept(ordered.withColumn(name, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(name, 33)
    sizes = sorted(tuple(r) for r in ordered.groupBy(part.alias("part")).count().collect())  # a row a partition
    bases = list(zip((p for p, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    based = rows.sparkSession.createDataFrame(bases, "part long, base long")
    return ordered.withColumn("part", part).join(F.broadcast(based), "part").withColumn(name, F.col("base") + F.col(name).bitwiseAND((1 << 33) - 1)).drop("part", "base")


def block_of(docno: str = "docno", bits: int = BITS) -> Column:
    return F.shiftright(docno, bits)


def place_in(docno: str = "docno", bits: int = BITS) -> Column:
    return F.col(docno).bitwiseAND((1 << bits) - 1)


def bit_at(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), place.bitwiseAND(7))), F.lit(2)) == 1


def counts_for(kind: Column, level: Column) -> Column:
    """Whether a word of this level counts for queries of a kind."""
    return (kind == WHOLE) | ((kind == FIELDS) & (level > 0)) | (level == 1)


def block_lists(lists: DataFrame, worth: Column, bits: int = BITS, kinds: bool = False) -> DataFrame:
    """(asked, block, bitmap, n, best, title, fields) of lists (asked, docno, level): one row a word and block, with ``kinds`` also for each kind."""
    level = F.col("level")
    if kinds:
        each = F.filter(F.array(*map(F.lit, (WHOLE, FIELDS, TITLES))), lambda k: counts_for(k, level))
        lists = lists.withColumn("kind", F.explode(each))
    return lists.groupBy("asked", *(["kind"] if kinds else []), block_of(bits=bits).alias("block")).agg(
        F.bitmap_construct_agg(place_in(bits=bits)).alias("bitmap"), F.count(F.lit(1)).alias("n"), F.max(worth).alias("best"),
        F.bool_or(level == 1).alias("title"), F.bool_or(level > 1).alias("fields"),
    )


def rank_key() -> Column:
    """What a hit is ranked by, but for the id; larger is better."""
    title = F.col("title_hits") > 0
    return F.struct(F.col("held").cast("int").alias("held"), title.cast("int").alias("title"), (~title & (F.col("field_hits") > 0)).cast("int").alias("fields"), F.col("score").cast("double").alias("score"), F.col("popularity").cast("long").alias("popularity"))


def intersected(prof: DataFrame, blocks: DataFrame, popularity: DataFrame, phrase_bonus: float, omit: bool = False, flat: float | None = None) -> DataFrame:
    """(query_id, omit, block, bitmap, hits, rarest, key): blocks with products that hold all required words, or all but the one at ``omit``; key bounds their rank keys.

    ``popularity``: (block, most). The bitmap of a block is that of its candidates, ``rarest`` the word of
    theirs with the fewest products there, ``hits`` how many of them are hits: with ``omit``, those without the word left out. ``flat``: the score of every hit but for the bonus, where words don't add up to it
    (of queries of the kind ``TITLES`` only, if ``prof`` has a column kind).
    """
    kinds = [c for c in ("kind",) if c in prof.columns]
    last = F.max(F.struct("at", (F.length("token") <= LONGEST_WHOLE).alias("brief"))).alias("last")
    places = prof.groupBy("query_id").agg(F.collect_list(F.when(F.col("required"), F.col("at"))).alias("places"), last)  # a query's own words
    gone = F.explode("places") if omit else F.lit(-1)
    prof = prof.join(places, "query_id").select("query_id", "at", "token", "required", "weight", "total", "needed", *kinds, "last", gone.alias("omit"))
    met = prof.join(blocks.withColumnRenamed("asked", "token"), ["token", *kinds])
    need, held = F.col("required"), F.col("at") != F.col("omit")
    must = need & held
    conjunction = lambda c: F.bitmap_and_agg(F.when(c, F.col("bitmap")).otherwise(F.lit(EVERY)))
    # products with all words are no hits when one is left out
    full = {"words": F.count_if(need), "full": conjunction(need)} if omit else {}
    # a word that isn't a must leaves the bitmap as it is
    both = met.groupBy("query_id", "omit", "block", "total", "needed", "last", *kinds).agg(
        F.count_if(must).alias("musts"), conjunction(must).alias("bitmap"), F.min(F.when(must, F.struct("n", "token"))).alias("rare"),
        F.coalesce(F.bool_or(must & F.col("title")), F.lit(False)).alias("title"), F.coalesce(F.bool_or(must & F.col("fields")), F.lit(False)).alias("fields"),
        F.count_if(must & F.col("title")).alias("titles"), F.sum(F.when(held, F.col("weight") * F.col("best")).otherwise(0.0)).alias("credit"), *(c.alias(name) for name, c in full.items()),
    )
    hits = F.bitmap_count("bitmap")
    if omit:
        hits = hits - F.when(F.col("words") == F.col("needed"), F.bitmap_count("full")).otherwise(0)
    both = both.where((F.col("musts") > 0) & (F.col("musts") == F.col("needed") - (1 if omit else 0))).withColumn("hits", hits).where("hits > 0")
    # a title with the phrase holds all words; only the last one may be the start of another there, and so not held if it's brief
    whole = F.col("titles") >= F.col("needed") - F.when(F.col("last.brief"), 1).otherwise(0)
    phrase = F.when((F.col("needed") > 1) & whole & F.col("omit").isin(-1, F.col("last.at")), phrase_bonus).otherwise(0.0)
    # rounded as scores are; what sums of floats may be off by is added
    base = F.col("credit") / F.col("total")
    if flat is not None:
        base = F.when(F.col("kind") == TITLES, float(flat)).otherwise(base) if kinds else F.lit(float(flat))
    score = F.round(base + phrase + 1e-9, 6)
    key = F.struct(F.col("musts").cast("int").alias("held"), F.col("title").cast("int").alias("title"), (~F.col("title") & F.col("fields")).cast("int").alias("fields"), score.alias("score"), F.col("most").alias("popularity"))
    return both.join(popularity, "block").select("query_id", "omit", "block", "bitmap", "hits", F.col("rare.token").alias("rarest"), key.alias("key"))


def opened(blocks: DataFrame, prof: DataFrame, lists: DataFrame, bits: int = BITS) -> DataFrame:
    """``prof`` with product_id and level: the candidates of some intersected blocks with all their words, held or not."""
    named = lists.withColumn("block", block_of(bits=bits)).select(F.col("asked").alias("rarest"), "block", "product_id", place_in(bits=bits).alias("place"))
    there = blocks.select("query_id", "block", "bitmap", "rarest").join(named, ["rarest", "block"]).where(bit_at(F.col("bitmap"), F.col("place")))
    pairs = there.select("query_id", "product_id").distinct()
    kinds = [c for c in ("kind",) if c in prof.columns]
    words = prof.select("query_id", "at", "token", "required", "weight", "total", "needed", *kinds).join(pairs, "query_id")
    held = words.join(lists.select(F.col("asked").alias("token"), "product_id", "level"), ["token", "product_id"])
    return held.where(counts_for(F.col("kind"), F.col("level"))) if kinds else held


def best_hits(prof: DataFrame, lists: DataFrame, popularity: DataFrame, score: Callable[[DataFrame], DataFrame], worth: Column, phrase_bonus: float, k: int, omit: bool = False, bits: int = BITS, flat: float | None = None) -> DataFrame:
    """Stored hits, scored, among which are the ``k`` best of each query that hold all required words, or with ``omit`` of those that hold all but one.

    ``lists``: stored (asked, product_id, docno, level); ``score`` makes hits of rows like ``opened``'s;
    ``flat``: see ``intersected``. A column kind of ``prof`` says which fields count for each query.
    """
    # products with all words are no hits here, and don't count among the k
    scored = (lambda found: score(found).where("held < needed")) if omit else score
    blocks = intersected(prof, block_lists(lists, worth, bits, "kind" in prof.columns), popularity, phrase_bonus, omit, flat)
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "block", "omit")
    before = F.coalesce(F.sum("hits").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = kept(blocks.withColumn("first", before < k), "turns")
    hits = kept(scored(opened(turns.where("first"), prof, lists, bits)), "hits")
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "product_id")
    kth = hits.select("query_id", "product_id", rank_key().alias("key")).withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", F.col("key").alias("least"))
    rest = kept(turns.where("not first").join(kth, "query_id", "left").where(F.col("least").isNull() | (F.col("key") >= F.col("least"))).drop("least"), "rest")
    if rest.isEmpty():
        return hits
    more = scored(opened(rest, prof, lists, bits)).join(hits.select("query_id", "product_id"), ["query_id", "product_id"], "left_anti")
    return hits.unionByName(kept(more, "more-hits"))
