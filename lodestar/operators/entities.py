"""Brands, platforms and condition that queries name, and what candidates have of them.

Names are found by whole phrases, longest first, in each spelling of a query; a phrase also stands for
the other terms of its alias groups. A candidate has a status in each dimension: 1 carries what is
named, -1 something else instead, 0 neither. A dimension is active if some candidate that carries it
holds the rest of the query too; the condition always is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, tokenize
from .lexicon import kept

#: Phrases that name a condition.
CONDITIONS = {"used": ("کارکرده", "کار کرده", "دست دوم", "used", "second hand", "secondhand"), "new": ("آکبند", "sealed")}
LONGEST_CONDITION = 2
PUBLISHER = " studios"
DIMENSIONS = ("brand", "platform", "condition")


def phrase(c) -> Column:
    return F.array_join(tokenize(normalize(c)), " ")


@dataclass
class Entities:
    """What a catalog can be asked for.

    ``brands``: (phrase, ambiguous); ``platforms``: key to spellings, a short list of the owner's;
    ``used``: (product_id) of used products, None without such data; ``blocked``: names never taken for brands.
    """

    brands: DataFrame
    platforms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    used: DataFrame | None = None
    conditions: dict[str, tuple[str, ...]] = field(default_factory=lambda: CONDITIONS)
    blocked: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()

    def platform_terms(self, alts: DataFrame) -> DataFrame:
        """(term, key): the platforms' spellings and their aliases; a term that several claim is the first one's."""
        spark = alts.sparkSession
        rows = [(i, k, s) for i, (k, names) in enumerate(self.platforms.items()) for s in names]
        own = spark.createDataFrame(rows, "at int, key string, spelling string").select("at", "key", phrase("spelling").alias("phrase")).where("phrase <> ''")
        more = own.join(alts, "phrase").select("at", "key", F.explode("alts").alias("words")).select("at", "key", F.array_join("words", " ").alias("term"))
        every = own.select("at", "key", F.col("phrase").alias("term")).unionAll(more)
        return every.groupBy("term").agg(F.min_by("key", "at").alias("key"))

    def names(self, alts: DataFrame) -> DataFrame:
        """(phrase, brand, ambiguous, key): what a phrase of a query may stand for, by itself or by its alias groups."""
        blocked = F.col("phrase").isin(*self.blocked) if self.blocked else F.lit(False)
        brands = self.brands.where((F.length("phrase") >= 2) & ~F.col("phrase").rlike("^[0-9]+$") & ~blocked).select(F.col("phrase").alias("brand"), "ambiguous").distinct()
        other = alts.select("phrase", F.explode("alts").alias("words")).select("phrase", F.array_join("words", " ").alias("brand"))
        by_name = brands.select(F.col("brand").alias("phrase"), "brand", "ambiguous").unionByName(brands.join(other, "brand").select("phrase", "brand", "ambiguous"))
        none = F.lit(None).cast("string")
        return by_name.withColumn("key", none).unionByName(self.platform_terms(alts).select(F.col("term").alias("phrase"), none.alias("brand"), F.lit(False).alias("ambiguous"), "key"))


def _runs(words: DataFrame, longest: Column) -> DataFrame:
    """(query_id, seq, start, len, phrase, generic): the runs of up to ``longest`` tokens."""
    size = F.size("tokens")
    ends = lambda i: F.transform(F.sequence(F.lit(1), F.least(longest, size - i)), lambda n: F.struct(i.alias("start"), n.alias("len")))
    runs = words.where(size > 0).select("*", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), size - 1), ends))))
    part = lambda c: F.slice(c, F.col("start") + 1, F.col("len"))
    return runs.select("query_id", "seq", "whole", "start", "len", F.array_join(part("tokens"), " ").alias("phrase"), F.forall(part("generic"), lambda g: g).alias("generic"))


def _from_left(found: DataFrame, *what: str) -> DataFrame:
    """Of (query_id, seq, start, len) those taken from the left, the longest at each start; all columns."""
    rows = found.groupBy("query_id", "seq").agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("len")).alias("order")))).alias("rows"))  # the runs of one query

    def take(acc: Column, x: Column) -> Column:
        new = F.struct((x["start"] - x["order"]).alias("next"), F.array_append(acc["out"], F.struct(x["start"].alias("start"), (-x["order"]).alias("len"))).alias("out"))
        return F.when(x["start"] >= acc["next"], new).otherwise(acc)

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<start:int,len:int>>").alias("out"))
    taken = rows.select("query_id", "seq", F.inline(F.aggregate("rows", start, take, lambda a: a["out"])))
    return taken.join(found, ["query_id", "seq", "start", "len"]).select("query_id", "seq", "start", "len", *what)


def recognized(asked: DataFrame, prof: DataFrame, entities: Entities, alts: DataFrame) -> DataFrame:
    """Stored: (query_id, brands, typed, ambiguous, platforms, rest, condition) of queries that name something, or of all with words if there's condition data.

    ``asked``: ``numbered_variants`` (query_id, own, seq, tokens) with their profile ``prof``. ``typed``:
    brands that the query itself names, not by a platform's or a generic word's alias. ``rest``: the
    words outside of names in the first spelling with one, without those of the condition.
    """
    flags = prof.groupBy(F.col("query_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", (~F.col("required")).alias("g")))), lambda x: x["g"]).alias("generic"))
    words = asked.join(flags, F.col("query_id") == F.col("id")).select(F.col("own").alias("query_id"), "seq", "tokens", "generic")
    stops = F.array(*map(F.lit, entities.stopwords)).cast("array<string>")
    words = kept(words.withColumn("whole", F.array_join(F.filter("tokens", lambda t: ~F.array_contains(stops, t)), " ")), "words")
    names = kept(entities.names(alts), "names")
    longest = names.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(0)).alias("longest"))  # one row
    runs = _runs(words.join(F.broadcast(longest)).where("longest > 0"), F.col("longest"))
    # an ambiguous brand only counts as the whole query
    found = runs.join(names, "phrase").where(F.col("brand").isNull() | ~F.col("ambiguous") | (F.col("phrase") == F.col("whole")))
    found = kept(_from_left(found, "phrase", "brand", "ambiguous", "key", "generic"), "found-names")
    terms = entities.platform_terms(alts).select(F.col("term").alias("phrase"), F.lit(True).alias("is_platform"))
    via = F.coalesce("is_platform", F.lit(False)) | F.col("generic")
    found = found.join(terms, "phrase", "left").withColumn("typed", (F.col("seq") == 0) & ((F.col("brand") == F.col("phrase")) | ~via))
    sets = found.groupBy("query_id").agg(
        F.collect_set("brand").alias("brands"), F.collect_set(F.when(F.col("typed"), F.col("brand"))).alias("typed"), F.collect_set(F.when(F.col("ambiguous"), F.col("brand"))).alias("ambiguous"),
        F.collect_set("key").alias("platforms"), F.min("seq").alias("first"),
    )
    publisher = lambda b: F.when(F.size("platforms") > 0, F.filter(b, lambda x: ~F.endswith(x, F.lit(PUBLISHER)))).otherwise(b)
    sets = sets.withColumns({c: F.array_sort(publisher(F.col(c))) for c in ("brands", "typed", "ambiguous")}).withColumn("platforms", F.array_sort("platforms"))
    first = sets.select("query_id", F.col("first").alias("seq"))
    inside = found.join(first, ["query_id", "seq"]).groupBy("query_id", "seq").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("len") - 1)))).alias("inside"))
    rest = words.join(inside, ["query_id", "seq"]).select("query_id", F.filter("tokens", lambda t, i: ~F.array_contains("inside", i)).alias("rest"))
    out = words.where("seq = 0").select("query_id").join(sets.drop("first"), "query_id", "left").join(rest, "query_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("brands", "typed", "ambiguous", "platforms", "rest")})
    if entities.used is None:
        return kept(out.where((F.size("brands") > 0) | (F.size("platforms") > 0)).withColumn("condition", F.lit(None).cast("string")), "recognized")
    named = conditions(words, entities.conditions)
    out = out.join(named, "query_id", "left").withColumn("rest", F.filter("rest", lambda t: ~F.array_contains(F.coalesce("said", none), t)))
    return kept(out.drop("said"), "recognized")


def conditions(words: DataFrame, terms: dict[str, tuple[str, ...]] = CONDITIONS) -> DataFrame:
    """Q11: (query_id, condition, said): the condition that a query's own words name, *used* before *new*, and those words.

    ``words``: (query_id, seq, tokens, ...). Phrases of up to two words are taken from the left, the longest first.
    """
    spark = words.sparkSession
    known = spark.createDataFrame([(t, c) for c, some in terms.items() for t in some], "term string, condition string").select(phrase("term").alias("phrase"), "condition")
    own = words.where("seq = 0").select("query_id", "seq", "tokens", F.lit("").alias("whole"), F.transform("tokens", lambda t: F.lit(False)).alias("generic"))
    hits = _from_left(_runs(own, F.lit(LONGEST_CONDITION)).join(F.broadcast(known), "phrase"), "phrase", "condition")
    said = F.array_distinct(F.flatten(F.collect_list(F.split("phrase", " "))))
    return hits.groupBy("query_id").agg(F.when(F.bool_or(F.col("condition") == "used"), "used").otherwise("new").alias("condition"), said.alias("said"))


def signals(products: DataFrame, entities: Entities, alts: DataFrame) -> DataFrame:
    """(product_id, brand, named, words, platforms, used) of every product: its brand phrase, the words of title, tags and category, those with the brand's, its platforms."""
    words = lambda *cs: F.concat(*(tokenize(normalize(c)) for c in cs))
    rows = products.select("product_id", phrase("brand").alias("brand"), words("title", "tags", "category").alias("w"), words("title", "tags", "category", "brand").alias("words"))
    rows = rows.withColumn("named", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).drop("w")
    # one row: the owner's few platforms with their aliases
    terms = entities.platform_terms(alts).agg(F.collect_list(F.struct("key", F.concat(F.lit(" "), F.col("term"), F.lit(" ")).alias("term"))).alias("terms"))
    own = F.array_sort(F.array_distinct(F.transform(F.filter("terms", lambda t: F.contains("named", t["term"])), lambda t: t["key"])))
    rows = rows.join(F.broadcast(terms)).withColumn("platforms", own).drop("terms")
    if entities.used is None:
        return rows.withColumn("used", F.lit(None).cast("boolean"))
    return rows.join(entities.used.select("product_id", F.lit(True).alias("used")).distinct(), "product_id", "left").withColumn("used", F.coalesce("used", F.lit(False)))


def statuses(candidates: DataFrame, named: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored: (query_id, product_id) of the candidates with brand, platform and condition (-1, 0, 1), and for each whether the query's candidates make it active.

    Also carried and mentioned: the query's brands that the candidate is of, or names in title, tags or category.
    ``named``: ``recognized``; ``facts``: ``signals``. Candidates of other queries aren't listed.
    """
    has = lambda b: F.contains("named", F.concat(F.lit(" "), b, F.lit(" ")))
    rows = candidates.select("query_id", "product_id").join(named, "query_id").join(facts.withColumnsRenamed({"brand": "own", "platforms": "own_platforms"}), "product_id")
    rows = rows.withColumn("carried", F.filter("brands", lambda b: b == F.col("own"))).withColumn("mentioned", F.filter("brands", has))
    brand = F.when((F.size("brands") == 0) | (F.col("own") == ""), 0).when(F.size("carried") > 0, 1).when(F.size("mentioned") > 0, 0).otherwise(-1)
    platform = F.when((F.size("platforms") == 0) | (F.size("own_platforms") == 0), 0).when(F.arrays_overlap("own_platforms", "platforms"), 1).otherwise(-1)
    asked_used = F.coalesce(F.col("condition") == "used", F.lit(False))
    condition = F.when(F.col("used").isNull(), 0).when(asked_used, F.when(F.col("used"), 1).otherwise(-1)).otherwise(F.when(F.col("used"), -1).otherwise(0))
    holds = F.forall("rest", lambda t: F.exists("words", lambda w: F.startswith(w, t)))
    rows = rows.select("query_id", "product_id", brand.alias("brand"), platform.alias("platform"), condition.alias("condition"), F.col("used").isNotNull().alias("condition_active"), holds.alias("holds"), "carried", "mentioned")
    q = Window.partitionBy("query_id")
    rows = rows.withColumns({f"{d}_active": F.coalesce(F.bool_or((F.col(d) == 1) & F.col("holds")).over(q), F.lit(False)) for d in ("brand", "platform")})
    return kept(rows.drop("holds"), "statuses")


def counted(rows: DataFrame) -> DataFrame:
    """``statuses`` with lifted and demoted: active dimensions in which a candidate has what is named, or something else."""
    sign = lambda d, s: F.when(F.col(f"{d}_active") & (F.col(d) == s), 1).otherwise(0)
    total = lambda s: sum((sign(d, s) for d in DIMENSIONS[1:]), sign(DIMENSIONS[0], s))
    return rows.withColumn("lifted", total(1)).withColumn("demoted", total(-1))


def reordered(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Q13, K8: hits (query_id, product_id, rank, ...) ranked anew: those with something else than named last, carriers first; within each as before."""
    marks = counted(rows).select("query_id", "product_id", F.when(F.col("demoted") > 0, 1).when(F.col("lifted") > 0, -1).otherwise(0).alias("turn"))
    both = hits.join(marks, ["query_id", "product_id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.coalesce("turn", F.lit(0)), "rank")
    return both.withColumn("rank", F.row_number().over(order)).drop("turn")


def evidence(named: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, brand, carried, mentioned, ambiguous, unmatched) of every brand that a query names.

    Unmatched: the query itself names it, there are candidates, and none is of it or mentions it.
    """
    per = rows.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_set("carried"))).alias("c"), F.array_distinct(F.flatten(F.collect_set("mentioned"))).alias("m"))  # sets of a query's own brands
    each = named.join(per, "query_id", "left").withColumn("brand", F.explode("brands"))
    seen = lambda c: F.coalesce(F.array_contains(c, F.col("brand")), F.lit(False))
    unmatched = F.array_contains("typed", F.col("brand")) & F.col("c").isNotNull() & ~seen("c") & ~seen("m")
    return each.select("query_id", "brand", seen("c").alias("carried"), seen("m").alias("mentioned"), F.array_contains("ambiguous", F.col("brand")).alias("ambiguous"), unmatched.alias("unmatched"))


def exempt(solid: Column, brand_active: Column, brand: Column) -> Column:
    """V8: whether a solid hit keeps its place below the relevance floor: not if the query names a brand that candidates carry and the hit is of another."""
    return solid & ~(F.coalesce(brand_active, F.lit(False)) & (F.coalesce(brand, F.lit(0)) < 0))
