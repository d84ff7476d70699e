"""Exact vector search and its blend with keyword hits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import unit
from ..functions.text import normalize, once, tokenize

KEYWORD_WEIGHT, SEMANTIC_WEIGHT, SOLID_COSINE, LEAST_RELEVANCE = 0.4, 0.6, 0.4, 0.45
STOCK, POPULARITY, BRAND, CATEGORY, TAG, TAG_WORDS = 0.1, 0.1, 0.15, 0.1, 0.1, 2
LIFT, DEMOTE, TAIL = 0.15, 0.10, 40
QUERIES_AT_ONCE, VECTORS_AT_ONCE, LEAST_VECTORS = 8192, 65_536, 4096
TILE_QUERIES, TILE_VECTORS, HELD = 256, 8192, 2_000_000


def _best(rows: DataFrame, k: int, least: float) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 100, least: float = 0.4, at_once: tuple[int, int] = (TILE_QUERIES, TILE_VECTORS)) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` most similar vectors with at least ``least``; ties to the smaller id.

    A stated query set against all rows: blocks of queries meet parts of the vectors, both of bounded
    size. In a task their matrix product is taken in tiles (``at_once``), whose best are merged, so that
    a task holds one tile of scores; each pair of block and part returns its own best ``k``.
    """
    import numpy as np
    import pyarrow as pa

    n = vectors.count()
    few = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // VECTORS_AT_ONCE), min(few, -(-n // LEAST_VECTORS)))
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    v = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = queries.select("query_id", F.col("embedding").alias("asked"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def units(rows: pa.Table, c: str) -> np.ndarray:
        m = np.array(rows.column(c).combine_chunks().flatten(), float).reshape(rows.num_rows, -1)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norms == 0, 1, norms)

    def best_of(scores: np.ndarray) -> np.ndarray:
        """Which of each row's scores are its best ``k``; of equal ones the first."""
        mask = scores >= least - 1e-6  # false for what isn't a number; rounding adds less
        mask[mask] = np.round(scores[mask], 6) >= least
        crowded = np.flatnonzero(mask.sum(axis=1) > k)  # others have no more than their best
        if len(crowded):
            some = np.where(mask[crowded], np.round(scores[crowded], 6), -np.inf)
            kth = np.partition(some, some.shape[1] - k, axis=1)[:, [some.shape[1] - k]]
            over, same = some > kth, some == kth
            mask[crowded] = over | (same & (np.cumsum(same, axis=1, dtype=np.int32) <= k - over.sum(axis=1, keepdims=True)))
        return mask

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0)
        rows = (none.astype(np.int64), none.astype(np.int64), none)  # place of the query, id, score
        if left.num_rows and right.num_rows:
            left = left.sort_by("id")
            asked, found, held = units(right, "asked"), [], 0
            ids = left.column("id").to_numpy()

            def merged() -> tuple[np.ndarray, ...]:
                at, near, scores = (np.concatenate(c) for c in zip(rows, *found))
                order = np.lexsort((near, -scores, at))
                at, near, scores = at[order], near[order], scores[order]
                first = np.arange(len(at)) - np.searchsorted(at, at) < k
                return at[first], near[first], scores[first]

            for j in range(0, left.num_rows, at_once[1]):
                a = units(left.slice(j, at_once[1]), "embedding").T
                for i in range(0, len(asked), at_once[0]):
                    scores = asked[i : i + at_once[0]] @ a
                    x, y = np.nonzero(best_of(scores))
                    found.append((x + i, ids[y + j], np.round(scores[x, y], 6)))
                    held += len(x)
                if held > HELD:
                    rows, found, held = merged(), [], 0
            rows = merged()
            rows = (right.column("query_id").to_numpy()[rows[0]], *rows[1:])
        return pa.table([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], names=["query_id", "id", "score"])

    found = v.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInArrow(run, "query_id long, id long, score double")
    return _best(found, k, least)


def words_in_query(field: Column, variants: Column) -> Column:
    """Some variant of the query holds every word of the field; an empty field never."""
    words = tokenize(normalize(field))
    return (F.size(words) > 0) & F.exists(variants, lambda v: F.size(F.array_except(words, v)) == 0)


def phrase_in_tags(tags: Column, variants: Column, least: int = TAG_WORDS) -> Column:
    """Some variant of at least ``least`` words is a run of the tags' words."""
    text = F.concat(F.lit(" "), F.array_join(tokenize(normalize(tags)), " "), F.lit(" "))
    return F.exists(variants, lambda v: (F.size(v) >= least) & F.contains(text, F.concat(F.lit(" "), F.array_join(v, " "), F.lit(" "))))


def blend(keyword: DataFrame, semantic: DataFrame, floor: float = LEAST_RELEVANCE) -> DataFrame:
    """(query_id, product_id, keyword, semantic, relevance, solid, hit_score, cosine, assumed) of the union of keyword hits and neighbours.

    hit_score and cosine are what came in, null for what didn't; assumed says that a cosine was taken for one. Both scores count relative to the query's best. A solid keyword hit that isn't a neighbour is taken
    to be one at the floor cosine, and is never dropped; others need ``floor``.
    """
    both = keyword.join(semantic, ["query_id", "product_id"], "full")
    q = Window.partitionBy("query_id")
    solid = F.coalesce("solid", F.lit(False))
    top_score, top_cosine = F.coalesce(F.max("score").over(q), F.lit(0.0)), F.coalesce(F.max("cosine").over(q), F.lit(0.0))
    both = both.select("query_id", "product_id", "score", "cosine", solid.alias("solid"), top_score.alias("top_score"), top_cosine.alias("top_cosine"))
    assumed = F.coalesce("cosine", F.when(F.col("solid"), F.least(F.lit(SOLID_COSINE), "top_cosine")).otherwise(0.0))
    k = F.when(F.col("top_score") > 0, F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))) / F.col("top_score")).otherwise(0.0)
    s = F.when(F.col("top_cosine") > 0, F.greatest(F.lit(0.0), assumed) / F.col("top_cosine")).otherwise(0.0)
    taken = F.col("cosine").isNull() & F.col("solid") & (s > 0)
    rows = both.select("query_id", "product_id", "solid", k.alias("keyword"), s.alias("semantic"), F.col("score").alias("hit_score"), "cosine", taken.alias("assumed"))
    rows = rows.withColumn("relevance", KEYWORD_WEIGHT * F.col("keyword") + SEMANTIC_WEIGHT * F.col("semantic"))
    return rows.where((F.col("relevance") >= floor) | F.col("solid"))


def boosted(blended: DataFrame, products: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds the score: relevance times boosts for stock, popularity (of the query's candidates), brand, category and tags.

    ``queries``: query_id and variants (array<array<string>>), and optionally categories and tags
    (array<string>) that its intents name: they count as if the query named them. Optional columns lifted
    and demoted of ``blended`` count the named entities that a product carries or contradicts.
    """
    none = F.array().cast("array<string>")
    named = {c: F.coalesce(c, none) if c in queries.columns else none for c in ("categories", "tags")}
    asked = queries.select("query_id", "variants", named["categories"].alias("named_categories"), named["tags"].alias("named_tags"))
    rows = blended.join(products.select("product_id", "stock", "popularity", "brand", "category", "tags"), "product_id").join(asked, "query_id")
    top = F.max("popularity").over(Window.partitionBy("query_id"))
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    boosts = 1.0 + on(F.col("stock") > 0, STOCK) + F.when(top > 0, POPULARITY * F.col("popularity") / top).otherwise(0.0)
    split = lambda names: F.transform(names, lambda n: tokenize(normalize(n)))
    category = words_in_query(F.col("category"), F.concat("variants", split(F.col("named_categories"))))
    tag = phrase_in_tags(F.col("tags"), F.col("variants")) | phrase_in_tags(F.col("tags"), split(F.col("named_tags")), 1)
    boosts = boosts + on(words_in_query(F.col("brand"), F.col("variants")), BRAND) + on(category, CATEGORY) + on(tag, TAG)
    lifted, demoted = (F.col(c) if c in blended.columns else F.lit(0) for c in ("lifted", "demoted"))
    score = F.col("relevance") * boosts * (1.0 + LIFT * lifted) * (1.0 - DEMOTE * demoted)
    return rows.select("query_id", "product_id", "solid", "relevance", F.round(score, 6).alias("score"))


def tail_capped(rows: DataFrame, tail: int = TAIL) -> DataFrame:
    """All solid rows and the first ``tail`` others of each query, in score order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "product_id")
    others = F.sum(F.when(F.col("solid"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("others", others).where(F.col("solid") | (F.col("others") <= tail)).drop("others")
    return kept.withColumn("rank", F.row_number().over(w))


def explained(blended: DataFrame, products: DataFrame, queries: DataFrame) -> DataFrame:
    """The score of each hit with its parts: what came in, keyword and semantic shares, whether a cosine was assumed, each boost and the factor of named entities."""
    rows = boosted(blended, products, queries).select("query_id", "product_id", "score")
    facts = blended.join(products.select("product_id", "stock", "popularity", "brand", "category", "tags"), "product_id").join(queries.select("query_id", "variants"), "query_id")
    on = lambda c, w: F.when(c, w).otherwise(0.0)
    top = F.max("popularity").over(Window.partitionBy("query_id"))
    lifted, demoted = (F.col(c) if c in blended.columns else F.lit(0) for c in ("lifted", "demoted"))
    parts = facts.select(
        "query_id", "product_id", F.round("hit_score", 6).alias("hit_score"), "cosine", "assumed", F.round(KEYWORD_WEIGHT * F.col("keyword"), 6).alias("keyword"), F.round(SEMANTIC_WEIGHT * F.col("semantic"), 6).alias("semantic"),
        on(F.col("stock") > 0, STOCK).alias("stock"), F.round(F.when(top > 0, POPULARITY * F.col("popularity") / top).otherwise(0.0), 6).alias("popularity"),
        on(words_in_query(F.col("brand"), F.col("variants")), BRAND).alias("brand"), on(words_in_query(F.col("category"), F.col("variants")), CATEGORY).alias("category"), on(phrase_in_tags(F.col("tags"), F.col("variants")), TAG).alias("tag"),
        F.round((1.0 + LIFT * lifted) * (1.0 - DEMOTE * demoted), 6).alias("factor"),
    )
    return rows.join(parts, ["query_id", "product_id"])


def served(neighbours: DataFrame, least: float = 0.4) -> DataFrame:
    """V4: neighbours as a client takes them: without malformed rows, at least ``least``, best first."""
    good = neighbours.where(F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= least))
    return good.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def mock_embedding(c: Column, dim: int = 64) -> Column:
    """V1: a unit vector that a text's hashes determine, for tests without a model; equal texts have equal vectors."""
    uniform = lambda i, salt: (F.pmod(F.xxhash64(c, i, F.lit(salt)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    # normal numbers by pairs of uniform ones
    raw = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1)))
    return once(raw, unit)
