"""Query rewriting: spelling, aliases, intents, brands; the recovery order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, en_to_fa, fa_to_en, keeps_digits, name_and_digits, normalize, tokenize, transpositions
from .lexicon import kept

LEAST_CORRECTED, SHORT_TOKEN, LATIN_TWO_EDITS, FIRST_LETTER, LEAST_FREQUENCY = 4, 4, 8, 6, 2
GROUP_TERMS, STEPS = 4, 8


def corrections(tokens: DataFrame, dictionary: DataFrame, blocked: tuple[str, ...] = (), longest: int = 1) -> DataFrame:
    """(token, correction) of unknown words of four or more characters; none where nothing is near enough.

    A swap of neighbours wins; else the fewest edits, the highest frequency, the first term. One edit is
    allowed, two for Latin words of eight or more that keep their first letter.
    """
    unknown = tokens.select("token").distinct().where((F.length("token") >= LEAST_CORRECTED) & ~F.col("token").rlike("^[0-9]+$")).join(dictionary, "token", "left_anti")
    unknown = unknown.select("token", name_and_digits(F.col("token")).alias("p")).select("token", "p.word", "p.digits")
    known = dictionary.where((F.col("freq") >= LEAST_FREQUENCY) & (~F.col("token").isin(*blocked) if blocked else F.lit(True))).select(F.col("token").alias("term"), "freq")
    unknown = unknown.where(F.length("word") >= LEAST_CORRECTED).join(dictionary.select(F.col("token").alias("word")), "word", "left_anti")
    swapped = unknown.withColumn("term", F.explode(transpositions(F.col("word")))).join(known, "term").select("token", "word", "digits", "term", "freq", F.lit(0).alias("edits"))
    reach = F.when((F.length("word") >= LATIN_TWO_EDITS) & F.col("word").rlike("^[a-z0-9]+$"), 2).otherwise(longest)
    # words that are so few edits apart have a form in common from which so many letters are deleted
    asked = unknown.withColumn("reach", reach).withColumn("form", F.explode(deletions(F.col("word"), F.col("reach"))))
    terms = known.withColumn("reach", F.explode(F.sequence(F.lit(1), F.lit(2)))).where((F.col("reach") == 1) | (F.length("term") >= LATIN_TWO_EDITS - 2))
    terms = terms.withColumn("form", F.explode(deletions(F.col("term"), F.col("reach"))))
    near = asked.join(terms, ["reach", "form"]).drop("form").distinct().withColumn("edits", F.levenshtein("word", "term", 2)).where((F.col("edits") >= 0) & (F.col("edits") <= F.col("reach")))
    same_start = F.substring("word", 1, 1) == F.substring("term", 1, 1)
    near = near.where(~F.contains("word", F.col("term")) & (same_start | ((F.length("word") > FIRST_LETTER) & (F.col("edits") <= longest))))
    best = Window.partitionBy("token").orderBy("edits", F.desc("freq"), "term")
    rows = swapped.unionByName(near.select("token", "word", "digits", "term", "freq", F.col("edits").cast("int").alias("edits")))
    rows = rows.withColumn("r", F.row_number().over(best)).where("r = 1")
    return rows.select("token", F.concat("term", "digits").alias("correction"))


def deletions(c: Column, most: Column) -> Column:
    """The text and its forms with one letter left out, or with up to two."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = F.array_distinct(F.concat(F.array(c), without(c)))
    return F.when(most > 1, F.array_distinct(F.concat(one, F.flatten(F.transform(one, without))))).otherwise(one)


def suggestions(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, suggestion) of queries with a corrected token; one that loses a digit is dropped."""
    tokens = queries.select("query_id", normalize("raw_q").alias("q")).select("query_id", "q", F.posexplode(tokenize("q")).alias("at", "token"))
    fixed = tokens.join(corrections(tokens, dictionary), "token", "left").withColumn("out", F.coalesce("correction", "token"))
    whole = fixed.groupBy("query_id", "q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), " ").alias("suggestion"), F.count("correction").alias("n"))
    return whole.where((F.col("n") > 0) & (F.col("suggestion") != F.col("q")) & keeps_digits(F.col("q"), F.col("suggestion"))).select("query_id", "suggestion")


def alias_groups(groups: DataFrame, blocked: tuple[str, ...] = ()) -> DataFrame:
    """Generated groups of at most four terms without a blocked one; owners' groups always."""
    bad = F.arrays_overlap("terms", F.array(*map(F.lit, blocked)).cast("array<string>")) if blocked else F.lit(False)
    return groups.where(F.col("owner") | ((F.size("terms") <= GROUP_TERMS) & ~bad))


def spacing_variants(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term) where the query is a known term with other spacing."""
    asked = queries.select("query_id", normalize("raw_q").alias("q"), collapse("raw_q").alias("c"))
    known = terms.select(normalize("term").alias("term"), collapse("term").alias("c"))
    return asked.join(known, "c").where("q <> term").groupBy("query_id").agg(F.min("term").alias("term"))


def phrases_in(queries: DataFrame, phrases: DataFrame, longest: int = 4) -> DataFrame:
    """(query_id, at, size, phrase): known phrases among the runs of a query's tokens, longest first, without overlap.

    A run is kept if no longer known one, or earlier one of the same length, covers part of it.
    """
    tokens = queries.select("query_id", tokenize(normalize("raw_q")).alias("t"))
    runs = tokens.select("query_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("t"), F.lit(1))), lambda i: F.struct((i - 1).alias("at"), n.alias("size"), F.array_join(F.slice("t", i, n), " ").alias("phrase"), F.size(F.slice("t", i, n)).alias("got")))))).alias("r")).select("query_id", "r.*").where("got = size").drop("got")
    found = runs.join(phrases.select("phrase").distinct(), "phrase")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "at", "size", "phrase")))

    def take(acc: Column, x: Column) -> Column:
        free = ~F.exists(acc, lambda y: (x["at"] < y["at"] + y["size"]) & (y["at"] < x["at"] + x["size"]))
        return F.when(free, F.array_append(acc, x)).otherwise(acc)

    empty = F.array().cast("array<struct<order:int,at:int,size:int,phrase:string>>")
    return found.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.inline(F.aggregate("rows", empty, take))).select("query_id", "at", "size", "phrase")


def entity_statuses(hits: DataFrame, products: DataFrame, named: DataFrame) -> DataFrame:
    """Adds brand_status: 1 carries the brand that the query names, -1 another brand, 0 none named; and whether the brand is active.

    ``named``: (query_id, brand). It is active if some candidate of the query carries it.
    """
    rows = hits.join(products.select("product_id", F.array_join(tokenize(normalize("brand")), " ").alias("brand")), "product_id")
    asked = named.groupBy("query_id").agg(F.collect_set("brand").alias("brands"))  # a query's own few names
    status = F.when(F.col("brands").isNull(), 0).when(F.array_contains("brands", F.col("brand")), 1).when(F.col("brand") == "", 0).otherwise(-1)
    rows = rows.join(asked, "query_id", "left").withColumn("brand_status", status)
    active = F.max(F.col("brand_status") == 1).over(Window.partitionBy("query_id"))
    return rows.withColumn("brand_active", active).drop("brands", "brand")


def candidates(queries: DataFrame, dictionary: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Stored: (query_id, step, rewritten): what to try when a query finds too little, in this order of steps:

    1 an alias in other spacing, 2 Latin keys read as Persian, 3 that corrected, 4 Persian keys read as
    Latin, 5 that corrected, 6 the query corrected.
    """
    q = normalize("raw_q")
    texts = [(2, normalize(en_to_fa("raw_q"))), (4, normalize(fa_to_en("raw_q"))), (6, q)]
    each = queries.select("query_id", q.alias("q"), F.explode(F.array(*(F.struct(F.lit(i).alias("step"), t.alias("text")) for i, t in texts))).alias("x")).select("query_id", "q", "x.*")
    each = kept(each.where((F.col("text") != "") & ((F.col("step") == 6) | (F.col("text") != F.col("q")))), "rewritten")
    fixed = suggestions(each.select((F.col("query_id") * STEPS + F.col("step")).alias("query_id"), F.col("text").alias("raw_q")), dictionary)
    fixed = fixed.select(F.floor(F.col("query_id") / STEPS).alias("query_id"), (F.col("query_id") % STEPS).cast("int").alias("step"), F.col("suggestion").alias("rewritten"))
    out = each.where("step < 6").select("query_id", "step", F.col("text").alias("rewritten")).unionByName(fixed.withColumn("step", F.when(F.col("step") == 6, 6).otherwise(F.col("step") + 1)))
    if terms is not None:
        out = out.unionByName(spacing_variants(queries, terms).select("query_id", F.lit(1).alias("step"), F.col("term").alias("rewritten")))
    return kept(out.select(F.col("query_id").cast("long").alias("query_id"), F.col("step").cast("int").alias("step"), "rewritten"), "tried")


def recover(queries: DataFrame, baseline: DataFrame, dictionary: DataFrame, search, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, step, rewritten, full) of the first rewriting of each query that is accepted, and its hits.

    Accepted is what finds more full hits than ``baseline`` (query_id, full) says of the query itself; of
    other key layouts also only what some hit names wholly in title or tags. All rewritings of all queries
    are searched as one batch. ``search``: queries to hits (query_id, product_id, partial, name_all, ...).
    """
    tried = candidates(queries, dictionary, terms)
    return accepted(tried, kept(search(keyed(tried)), "tried-hits"), baseline)


def keyed(tried: DataFrame) -> DataFrame:
    """Rewritings as queries of their own, (query_id, raw_q); see ``STEPS``."""
    return tried.select((F.col("query_id") * STEPS + F.col("step")).alias("query_id"), F.col("rewritten").alias("raw_q"))


def accepted(tried: DataFrame, hits: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``recover`` gives, from the stored hits of the ``keyed`` rewritings."""
    key = F.col("query_id") * STEPS + F.col("step")
    counts = hits.groupBy("query_id").agg(F.count_if(~F.col("partial")).alias("full"), F.bool_or("name_all").alias("named"))
    own = F.coalesce("own", F.lit(0))
    met = tried.withColumn("key", key).join(counts.withColumnRenamed("query_id", "key"), "key").join(baseline.select("query_id", F.col("full").alias("own")), "query_id", "left")
    met = met.where((F.col("full") > own) & (F.col("named") | F.col("step").isin(1, 6)))
    first = kept(met.groupBy("query_id").agg(F.min_by(F.struct("step", "rewritten", "full", "key"), "step").alias("b")).select("query_id", "b.*"), "recovered")
    theirs = hits.withColumnRenamed("query_id", "key").join(first.select("query_id", "key"), "key").drop("key")
    return first.drop("key"), theirs


def collected_names(sources: list[DataFrame]) -> DataFrame:
    """Q21: (name, source): the names of several lists; one that comes again keeps its first source."""
    rows = None
    for i, df in enumerate(sources):
        one = df.select(F.trim("name").alias("name"), F.lit(i).alias("source")).where("name <> ''")
        rows = one if rows is None else rows.unionAll(one)
    return rows.groupBy("name").agg(F.min("source").alias("source"))
