"""The search as a whole: from a batch of queries to final lists, keyword tier first, then blended with neighbours.

Every stage takes the queries that need it and no others: partial hits, other spacings, recovery, any
of the words and intents each read a table of the queries that the stages before left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, tokenize
from . import entities as N
from .lexicon import kept
from .retrieve import SOFT_FACTOR, SOFT_SHARE, Index, intent_hits, merge_best, profile, query_tokens, ranked, scored, spacing_can_rank
from .rewrite import STEPS, accepted, candidates, keyed, recover
from .variants import VARIANTS, alternatives, as_hits, numbered_variants, short_variants, text_hits, variants
from .vector import blend, boosted, tail_capped, top_k

ENOUGH = 3  # full hits below which partial ones are added and a correction is looked for
LATER = 10_000_000  # places of hits of the later stages


def generic_only(queries: DataFrame, index: Index) -> DataFrame:
    """(query_id, generic_only): whether a query has words, all of them generic. Queries without a word aren't listed."""
    return profile(queries, index.products, index.ratio).groupBy("query_id").agg((F.max("needed") == 0).alias("generic_only"))


def resolve_intents(queries: DataFrame, intents: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, categories, tags) named by the first ``most`` terms found in a query, from left to right and the longest first.

    ``intents``: term, categories, tags. A found term's words aren't part of another's; names come in the order found.
    """
    known = intents.select(F.array_join(tokenize(normalize("term")), " ").alias("phrase"), "categories", "tags").where("phrase <> ''")
    longest = known.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(0)).alias("longest"))  # one row
    words = queries.select("query_id", tokenize(normalize("raw_q")).alias("words")).where(F.size("words") > 0).join(F.broadcast(longest))
    sizes = lambda i: F.transform(F.sequence(F.lit(1), F.least("longest", F.size("words") - i)), lambda n: F.struct(i.alias("at"), (-n).alias("order"), F.array_join(F.slice("words", i + 1, n), " ").alias("phrase")))
    runs = words.where("longest > 0").select("query_id", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), sizes))))
    rows = runs.join(known, "phrase").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "order", "categories", "tags"))).alias("rows"))  # a query's own few terms

    def take(acc: Column, x: Column) -> Column:
        new = F.struct((x["at"] - x["order"]).alias("next"), (acc["n"] + 1).alias("n"), F.array_union(acc["categories"], x["categories"]).alias("categories"), F.array_union(acc["tags"], x["tags"]).alias("tags"))
        return F.when((x["at"] >= acc["next"]) & (acc["n"] < most), new).otherwise(acc)

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("next"), F.lit(0).alias("n"), none.alias("categories"), none.alias("tags"))
    return rows.select("query_id", F.aggregate("rows", start, take).alias("r")).select("query_id", "r.categories", "r.tags")


def _swapped_partial(index: Index, asked: DataFrame, prof: DataFrame, lists: DataFrame, thin: DataFrame, limit: int) -> DataFrame:
    """Partial hits of other spellings in structured fields: products with a word that the spelling brought in and half of its required words."""
    own = asked.where("seq = 0").select("own", F.col("tokens").alias("typed"))
    some = asked.where("seq > 0").join(thin.select(F.col("query_id").alias("own")), "own").join(own, "own").select("query_id", "tokens", F.array_except("tokens", "typed").alias("new")).where(F.size("new") > 0)
    mine = prof.where("needed > 1").join(some.select("query_id"), "query_id", "left_semi")
    mine = kept(mine.join(short_variants(mine), "query_id", "left_anti"), "swapped")
    lists = lists.where("level > 0")
    pairs = some.select("query_id", F.explode("new").alias("asked")).join(lists, "asked").select("query_id", "product_id").distinct()
    found = mine.join(pairs, "query_id").join(lists.select(F.col("asked").alias("token"), "product_id", "level"), ["token", "product_id"])
    hits = scored(found, asked, index.products).where((F.col("held") < F.col("needed")) & (F.col("held") >= F.ceil(F.col("needed") * SOFT_SHARE)))
    return ranked(hits.withColumn("score", F.round(F.col("score") * SOFT_FACTOR, 7)), limit)


def found_hits(index: Index, queries: DataFrame, limit: int = 20, alts: DataFrame | None = None, alias_words: DataFrame | None = None) -> DataFrame:
    """Stored: (query_id, product_id, match_type, partial, name_all, solid, score, rank) of codes and texts.

    Codes come first. Of the texts, products with every required word count, of the query or with
    ``alts`` (``alternatives``) of another spelling; names written with other spacing, unless the last
    place is taken by what they can't beat; and, for fewer than ``ENOUGH`` of those, products with half
    of the words. Queries of generic words only have no text hits.
    """
    return _found(index, queries, limit, alts, alias_words)[0]


def _found(index: Index, queries: DataFrame, limit: int = 20, alts: DataFrame | None = None, alias_words: DataFrame | None = None, codes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``found_hits``, and the stored lists of all words of all spellings, made once. ``codes``: what ``Index.sku`` gives, if made before."""
    own = queries.select("query_id", F.lit(0).alias("seq"), query_tokens(queries).alias("tokens")).where(F.size("tokens") > 0)
    asked = numbered_variants(own if alts is None else variants(queries, alts, alias_words))
    prof = index.profile(asked)
    lists = index.lists(prof)
    typed = prof.join(asked.where("seq = 0").select("query_id", "own"), "query_id").drop("query_id").withColumnRenamed("own", "query_id")
    typed = kept(typed, "typed")
    shape = kept(typed.groupBy("query_id").agg(F.count(F.lit(1)).alias("words"), F.max("needed").alias("needed")), "shape")
    able = shape.where("needed > 0").select("query_id")
    whole = kept(merge_best(text_hits(index, asked, prof, limit, lists).join(able, "query_id", "left_semi"), limit), "whole")
    closed = whole.select("query_id").distinct().join(spacing_can_rank(whole, limit), "query_id", "left_anti")
    spaced = index.collapsed(queries.join(able, "query_id", "left_semi").join(closed, "query_id", "left_anti"), limit)
    spaced = spaced.join(whole.select("query_id", "product_id"), ["query_id", "product_id"], "left_anti")
    spaced = spaced.select("query_id", "product_id", F.lit(False).alias("partial"), F.lit(1.0).alias("coverage"), "title_match", (~F.col("title_match")).alias("spec_match"), "name_all", "score", (F.col("rank") + LATER).cast("long").alias("seq"))
    full = kept(whole.drop("rank").unionByName(spaced), "full")
    counts = full.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    thin = kept(shape.where("words > 1 and needed > 0").join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(ENOUGH, limit)).select("query_id"), "thin")
    few = kept(typed.join(thin, "query_id", "left_semi"), "thin-profile")
    some = as_hits(index.soft(few, lists, queries, limit), F.col("rank") + 2 * LATER, True)
    if alts is not None:
        more = _swapped_partial(index, asked, prof, lists, thin, limit)
        more = as_hits(more, F.col("query_id") % VARIANTS * 100_000 + F.col("rank") + 3 * LATER, True).join(asked.select("query_id", "own"), "query_id").drop("query_id").withColumnRenamed("own", "query_id")
        some = some.unionByName(more)
    text = merge_best(full.unionByName(some), limit)
    solid = F.col("name_all") & ~F.col("partial")
    text = text.select("query_id", "product_id", F.when(F.col("partial"), "partial").otherwise("text").alias("match_type"), "partial", "name_all", solid.alias("solid"), "score", "rank", F.lit(1).alias("source"))
    codes = (index.sku(queries, limit) if codes is None else codes).select("query_id", "product_id", F.lit("sku").alias("match_type"), F.lit(False).alias("partial"), F.lit(True).alias("name_all"), F.lit(True).alias("solid"), "score", "rank", F.lit(0).alias("source"))
    codes = kept(codes, "codes")
    both = codes.unionByName(text.join(codes.select("query_id", "product_id"), ["query_id", "product_id"], "left_anti"))
    order = Window.partitionBy("query_id").orderBy("source", "rank")
    return kept(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("source"), "found"), lists


def recovered(index: Index, queries: DataFrame, found: DataFrame, dictionary: DataFrame, limit: int = 20, alts: DataFrame | None = None, alias_words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, did_you_mean, applied) for queries without a code hit and with fewer than ``ENOUGH`` full hits, and ``found`` with what is applied.

    The suggestion is always shown; its hits replace the query's only where that has no full one.
    """
    thin = _thin(queries.where(normalize("raw_q") != ""), found)
    better, theirs = recover(thin, thin, dictionary, lambda q: found_hits(index, q, limit, alts, alias_words), _terms(alts))
    return _applied(found, thin, better, theirs)


def _terms(alts: DataFrame | None) -> DataFrame | None:
    return None if alts is None else alts.select(F.col("phrase").alias("term"))


def _thin(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Stored: the queries with how many full hits they have (full), without a code hit and with fewer than ``ENOUGH`` full ones."""
    counts = found.groupBy("query_id").agg(F.count_if(F.col("match_type") == "sku").alias("codes"), F.count_if(~F.col("partial")).alias("full"))
    zero = F.lit(0)
    thin = queries.join(counts, "query_id", "left").where((F.coalesce("codes", zero) == 0) & (F.coalesce("full", zero) < ENOUGH))
    return kept(thin.select(F.col("query_id").cast("long").alias("query_id"), "raw_q", F.coalesce("full", zero).alias("full")), "thin")


def _applied(found: DataFrame, thin: DataFrame, better: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    shown = kept(better.join(thin.select("query_id", F.col("full").alias("literal")), "query_id").select("query_id", F.col("rewritten").alias("did_you_mean"), (F.col("literal") == 0).alias("applied")), "shown")
    applied = shown.where("applied").select("query_id")
    return shown, kept(found.join(applied, "query_id", "left_anti").unionByName(theirs.join(applied, "query_id", "left_semi")), "found")


def searched(index: Index, queries: DataFrame, dictionary: DataFrame, limit: int = 20, alts: DataFrame | None = None, alias_words: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``recovered`` makes of ``found_hits``, and the lists of all words, in one pass.

    Queries without a code hit are searched together with all that may be tried instead of them, so that
    the steps of a search run once; rewritings of queries that found enough are then left out.
    """
    typed = queries.select(F.col("query_id").cast("long").alias("query_id"), "raw_q")
    codes = kept(index.sku(typed, limit), "typed-codes")
    words = kept(typed.where(normalize("raw_q") != "").join(codes, "query_id", "left_anti"), "uncoded")
    tried = candidates(words, dictionary, _terms(alts))
    again, own = keyed(tried), (F.col("query_id") * STEPS).alias("query_id")
    codes = codes.withColumn("query_id", own).unionByName(index.sku(again, limit))
    hits, lists = _found(index, typed.select(own, "raw_q").unionByName(again), limit, alts, alias_words, codes)
    step = F.pmod("query_id", F.lit(STEPS))
    found = hits.where(step == 0).withColumn("query_id", F.shiftright("query_id", STEPS.bit_length() - 1))
    thin = _thin(words, found)
    better, theirs = accepted(tried.join(thin.select("query_id"), "query_id", "left_semi"), hits.where(step > 0), thin)
    return *_applied(found, thin, better, theirs), lists


def completed(index: Index, queries: DataFrame, found: DataFrame, intents: DataFrame | None = None, limit: int = 20, lists: DataFrame | None = None) -> DataFrame:
    """``found`` with hits for the queries that have none: any of several words; for generic words only, the products of the intents they name.

    ``lists``: those of all words of the queries, if made before.
    """
    empty = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    shape = index.profile(empty).groupBy("query_id").agg(F.count(F.lit(1)).alias("words"), F.max("needed").alias("needed"))
    shape = kept(shape, "nothing")
    again = queries.join(shape.where("words > 1 and needed > 0").select("query_id"), "query_id", "left_semi")
    hit = lambda df, kind, named: df.select("query_id", "product_id", kind.alias("match_type"), F.col("partial"), named.alias("name_all"), (named & ~F.col("partial")).alias("solid"), "score", "rank")
    any_of = index.any_terms(again, limit, lists)
    out = found.unionByName(hit(any_of, F.when(F.col("partial"), "partial").otherwise("text"), F.col("name_hits") >= F.col("needed")))
    if intents is None:
        return out
    named = queries.join(shape.where("needed = 0").select("query_id"), "query_id", "left_semi")
    rows = intent_hits(resolve_intents(named, intents), index.products, limit).withColumns({"partial": F.lit(False), "score": F.lit(0.0)})
    return out.unionByName(hit(rows, F.lit("intent"), F.lit(False)))


def keyword_search(index: Index, queries: DataFrame, intents: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(query_id, rank, product_id, match_type, score) of every query's keyword hits as typed; see ``found_hits`` and ``completed``."""
    return completed(index, queries, found_hits(index, queries, limit), intents, limit).select("query_id", "rank", "product_id", "match_type", "score")


def answered(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """V9: (query_id) of queries of several words whose words all their hits hold, none by its code: they get no neighbours besides."""
    several = queries.where(F.size(tokenize(normalize("raw_q"))) > 1).select("query_id")
    whole = hits.groupBy("query_id").agg(F.bool_and(F.col("match_type") == "text").alias("whole")).where("whole")
    return whole.join(several, "query_id", "left_semi").select("query_id")


def neighbours(hits: DataFrame, gated: DataFrame, asked: DataFrame, vectors: DataFrame, k: int = 100, least: float = 0.4) -> DataFrame:
    """(query_id, product_id, cosine): the ``k`` nearest vectors of open queries; of ``gated`` ones only those of their own hits, pair by pair.

    ``asked``: (query_id, embedding); ``vectors``: (id, embedding). Gated queries take no part in the search over all vectors.
    """
    wide = top_k(asked.join(gated, "query_id", "left_anti"), vectors, k, least).select("query_id", F.col("id").alias("product_id"), F.col("score").alias("cosine"))
    own = hits.join(gated, "query_id", "left_semi").select("query_id", "product_id").join(asked.withColumnRenamed("embedding", "asked"), "query_id").join(vectors.withColumnRenamed("id", "product_id"), "product_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cosine = F.round(F.try_divide(dot("asked", "embedding"), F.sqrt(dot("asked", "asked")) * F.sqrt(dot("embedding", "embedding"))), 6)
    return wide.unionByName(own.select("query_id", "product_id", cosine.alias("cosine")).where(F.col("cosine") >= least))


def hybrid_search(index: Index, queries: DataFrame, keyword: DataFrame, semantic: DataFrame, limit: int = 20, asked: DataFrame | None = None, status=None) -> DataFrame:
    """(query_id, rank, product_id, score, pinned): keyword hits and neighbours as one list, code hits pinned to the top.

    ``keyword``: what ``keyword_search`` gives, with a column solid; ``semantic``: (query_id, product_id,
    cosine). Candidates are the union of all three; ids that the catalog lacks are dropped. ``asked``:
    (query_id, variants, categories, tags) that boosts count, else the queries' own words. ``status``
    gives the ``statuses`` of candidates (query_id, product_id): they lift, demote, and take a solid
    hit's exemption.
    """
    there = index.products.select("product_id")
    codes = keyword.where("match_type = 'sku'").join(there, "product_id", "left_semi").select("query_id", "product_id", "rank")
    words = keyword.where("match_type <> 'sku'").select("query_id", "product_id", "score", "solid").join(there, "product_id", "left_semi")
    near = semantic.join(there, "product_id", "left_semi")
    asked = queries.select("query_id", F.array(tokenize(normalize("raw_q"))).alias("variants")) if asked is None else asked
    if status is None:
        blended = blend(words, near)
    else:
        every = kept(codes.select("query_id", "product_id").union(words.select("query_id", "product_id")).union(near.select("query_id", "product_id")).distinct(), "candidates")
        marks = N.counted(status(every)).select("query_id", "product_id", "brand", "brand_active", "lifted", "demoted")
        safe = N.exempt(F.col("solid"), F.col("brand_active"), F.col("brand"))
        words = words.join(marks, ["query_id", "product_id"], "left").select("query_id", "product_id", "score", safe.alias("solid"))
        blended = blend(words, near).join(marks.select("query_id", "product_id", "lifted", "demoted"), ["query_id", "product_id"], "left").fillna(0, ["lifted", "demoted"])
    scores = tail_capped(boosted(blended, index.products, asked))
    both = codes.withColumns({"score": F.lit(None).cast("double"), "pinned": F.lit(True)}).unionByName(
        scores.join(codes.select("query_id", "product_id"), ["query_id", "product_id"], "left_anti").select("query_id", "product_id", "rank", "score", F.lit(False).alias("pinned"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("pinned"), "rank")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "product_id", "score", "pinned")


def complete_search(index: Index, queries: DataFrame, groups: DataFrame, dictionary: DataFrame, entities: N.Entities, intents: DataFrame, embed, vectors: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """The final list (``hybrid_search``) and suggestions (query_id, did_you_mean, applied), with every stage of the search.

    ``groups``: owners' alias groups (group, terms); ``embed``: queries (query_id, text) to (query_id, embedding).
    What boosts, names and vectors are taken from is the applied suggestion, where there's one.
    """
    alts = kept(alternatives(groups), "alternatives")
    alias_words = groups.select(F.explode("terms").alias("term")).select(F.explode(tokenize(normalize("term"))).alias("token")).distinct()
    shown, found, words = searched(index, queries, dictionary, limit, alts, alias_words)
    hits = kept(completed(index, queries, found, intents, limit, words), "hits")
    meant = shown.where("applied").select("query_id", "did_you_mean")
    texts = kept(queries.join(meant, "query_id", "left").select("query_id", F.coalesce("did_you_mean", normalize("raw_q")).alias("raw_q")), "texts")
    spelled = numbered_variants(variants(texts, alts, alias_words))
    lists = spelled.groupBy(F.col("own").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tokens"))), lambda x: x["tokens"]).alias("variants"))
    asked = kept(lists.join(resolve_intents(texts, intents), "query_id", "left"), "asked")
    named = N.recognized(spelled, index.profile(spelled), entities, alts)
    facts = kept(N.signals(index.products, entities, alts), "signals")
    gated = kept(answered(queries, hits), "answered")
    near = kept(neighbours(hits, gated, kept(embed(texts.withColumnRenamed("raw_q", "text")), "embedded"), vectors), "neighbours")
    return hybrid_search(index, queries, hits, near, limit, asked, lambda c: N.statuses(c, named, facts)), shown
