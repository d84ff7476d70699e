"""Spellings, alias hits, entities, recovery and the gate for neighbours, on small catalogs."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import entities as N
from lodestar.operators import lexicon, retrieve, rewrite, search
from lodestar.operators import variants as A

COLUMNS = "product_id long, title string, tags string, brand string, category string, description string"


def catalog(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS).withColumns({"specs": F.lit(""), "sku": F.concat(F.lit("XX-"), "product_id"), "popularity": 100 - F.col("product_id"), "stock": F.lit(1)})


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, raw_q string")


def grouped(spark, *groups):
    return spark.createDataFrame(list(enumerate(map(list, groups))), "group long, terms array<string>")


def spelled(spark, groups, *texts, words=None, most=6):
    owned = spark.createDataFrame([(w,) for w in words], "token string") if words else None
    out = {i + 1: [] for i in range(len(texts))}
    for r in A.variants(asked(spark, *texts), A.alternatives(grouped(spark, *groups)), owned, most).orderBy("query_id", "seq").collect():
        out[r.query_id].append(" ".join(r.tokens))
    return [out[i + 1] for i in range(len(texts))]


def test_model_numbers_and_spacing(spark):
    got = spelled(spark, [("gta 6", "grand theft"), ("playstation 4", "ps4"), ("azure", "blue")], "gta6", "gta 6", "play station 4", "ps 4", "azure7", "")
    assert got[0] == ["gta6", "gta 6", "grand theft"]
    assert got[1] == ["gta 6", "grand theft", "gta6"]
    assert got[2][:3] == ["play station 4", "playstation 4", "ps4"] and got[5] == []
    assert got[3] == ["ps 4", "ps4", "playstation 4"] and got[4] == ["azure7", "azure 7", "blue 7"]


def test_single_swaps_before_all_at_once(spark):
    groups = [("hot gear", "warm"), ("x", "y", "z")]
    assert spelled(spark, groups, "hot gear x")[0] == ["hot gear x", "warm x", "hot gear y", "hot gear z", "warm y", "warm z"]
    assert spelled(spark, groups, "hot gear x", most=3)[0] == ["hot gear x", "warm x", "hot gear y"]
    # the longest phrase from the left; terms of several groups; a term alone in its group
    assert spelled(spark, [("a b", "c"), ("a", "q"), ("b", "r")], "a b")[0] == ["a b", "c"]
    assert spelled(spark, [("a", "b"), ("a", "c")], "a")[0] == ["a", "b", "c"] and spelled(spark, [("a",)], "a")[0] == ["a"]


def test_numbers_join_alias_words(spark):
    assert spelled(spark, [("فیفا", "fifa")], "فیفا 26")[0] == ["فیفا 26", "fifa 26"]
    assert spelled(spark, [("فیفا", "fifa")], "فیفا 26", words=["فیفا"])[0] == ["فیفا 26", "fifa 26", "فیفا26"]


def test_alias_hits_need_structured_fields_or_titles(spark):
    products = catalog(spark, (1, "Lamp", "", "", "", "a gadget"), (2, "Lamp", "gadget", "", "", ""), (3, "Gizmo", "", "", "", ""), (4, "Thing pc", "", "", "", ""), (5, "Thing", "pc", "", "", ""))
    index, alts = retrieve.Index(products, 0.99), A.alternatives(grouped(spark, ("gizmo", "gadget"), ("computer", "pc")))
    got = {(r.query_id, r.product_id) for r in A.variant_hits(index, asked(spark, "gizmo", "computer"), alts).collect()}
    # not in a description alone; a short word only in a title
    assert got == {(1, 3), (1, 2), (2, 4)}


def recognize(spark, index, entities, alts, *texts):
    made = A.numbered_variants(A.variants(asked(spark, *texts), alts))
    return N.recognized(made, index.profile(made), entities, alts)


@pytest.fixture(scope="module")
def shop(spark):
    products = catalog(
        spark, (1, "Xiaomi phone", "mobile", "Xiaomi", "Phones", ""), (2, "LG monitor", "screen", "LG", "Monitors", ""), (3, "Monitor for xiaomi", "screen", "Other", "Monitors", ""),
        (4, "FIFA ps4", "game", "", "PlayStation 4 games", ""), (5, "FIFA pc", "game", "", "PC games", ""), (6, "Used xiaomi phone", "mobile", "Xiaomi", "Phones", ""), (7, "Blue phone", "mobile", "Blue", "Phones", ""),
    )
    brands = spark.createDataFrame([("xiaomi", False), ("lg", False), ("blue", True), ("deadskull", False), ("acme studios", False)], "phrase string, ambiguous boolean")
    used = spark.createDataFrame([(6,)], "product_id long")
    alts = A.alternatives(grouped(spark, ("شیامی", "xiaomi"), ("ps4", "playstation 4"), ("games", "acme studios")))
    return retrieve.Index(products, 0.99), N.Entities(brands, {"ps4": ("ps4",), "pc": ("pc",)}, used), alts


def test_names_in_queries(spark, shop):
    index, known, alts = shop
    texts = ["شیامی phone", "blue phone", "blue", "fifa playstation 4", "used second hand sealed phone", "کار کرده xiaomi", "ps4 games", "nothing"]
    got = {r.query_id: r for r in recognize(spark, index, known, alts, *texts).collect()}
    assert got[1].brands == ["xiaomi"] and got[1].typed == ["xiaomi"] and got[1].rest == ["phone"]
    assert got[2].brands == [] and got[3].brands == ["blue"] and got[3].ambiguous == ["blue"]
    assert got[4].platforms == ["ps4"] and got[4].rest == ["fifa"]
    # both conditions are named: used wins; its words aren't part of the rest
    assert got[5].condition == "used" and got[5].rest == [] and got[6].condition == "used" and got[6].brands == ["xiaomi"] and got[6].rest == []
    # a publisher isn't a brand beside a platform
    assert got[7].platforms == ["ps4"] and got[7].brands == [] and got[8].brands == got[8].platforms == [] and got[8].condition is None


def test_statuses_and_evidence(spark, shop):
    index, known, alts = shop
    named = recognize(spark, index, known, alts, "xiaomi monitor", "xiaomi phone", "fifa ps4", "deadskull phone", "lg phone")
    pairs = spark.createDataFrame([(q, p) for q in (1, 2, 3, 4) for p in range(1, 8)], "query_id long, product_id long")
    rows = N.statuses(pairs, named, N.signals(index.products, known, alts))
    got = {(r.query_id, r.product_id): r for r in rows.collect()}
    # the brand is carried by phones only, so monitors keep their places; a mention is neutral
    assert [got[1, p].brand for p in (1, 2, 3, 4)] == [1, -1, 0, 0] and not got[1, 1].brand_active and got[2, 1].brand_active
    assert [got[3, p].platform for p in (1, 4, 5)] == [0, 1, -1] and got[3, 4].platform_active
    assert [got[2, p].condition for p in (1, 6)] == [0, -1]
    seen = {(r.query_id, r.brand): (r.carried, r.mentioned, r.unmatched) for r in N.evidence(named, rows).collect()}
    assert seen[1, "xiaomi"] == (True, True, False) and seen[4, "deadskull"] == (False, False, True) and seen[5, "lg"] == (False, False, False)
    only = N.statuses(spark.createDataFrame([(1, 3)], "query_id long, product_id long"), named, N.signals(index.products, known, alts))
    assert {(r.query_id, r.brand): r.unmatched for r in N.evidence(named, only).collect()}[1, "xiaomi"] is False
    hits = spark.createDataFrame([(2, p, i) for i, p in enumerate((2, 6, 4, 1), 1)], "query_id long, product_id long, rank int")
    assert [r.product_id for r in N.reordered(hits, rows).orderBy("rank").collect()] == [1, 4, 2, 6]
    safe = rows.where("query_id in (1, 2)").select("query_id", "product_id", N.exempt(F.lit(True), F.col("brand_active"), F.col("brand")).alias("safe"))
    assert {(r.query_id, r.product_id) for r in safe.where("not safe").collect()} == {(2, 2), (2, 7)}


def test_recovery_lattice(spark):
    products = catalog(spark, (1, "gizmo", "", "", "", ""), (2, "gizmo lamp", "", "", "", ""), (3, "box", "", "", "", "lantern"), (4, "play station", "", "", "", ""), (5, "gizmo", "", "", "", ""))
    index = retrieve.Index(products, 0.99)
    words = spark.createDataFrame([("gizmo", 5), ("lamp", 4), ("lantern", 3)], "token string, freq long")
    persian = lambda t: spark.range(1).select(T.en_to_fa(F.lit(t)).alias("t")).first().t
    queries = asked(spark, "gizom", persian("gizmo"), persian("gizom"), persian("lantern"), "playstation", "lamp", "lantrn")
    search_ = lambda q: A.as_hits(index.strict(q), F.col("rank"))
    own = index.strict(queries).groupBy("query_id").agg(F.count(F.lit(1)).alias("full"))
    first, hits = rewrite.recover(queries, own, words, search_, spark.createDataFrame([("play station",)], "term string"))
    got = {r.query_id: (r.step, r.rewritten, r.full) for r in first.collect()}
    # spelling; another layout; spelling of the other layout; not what stands in a description alone; an alias; nothing better
    assert got == {1: (6, "gizmo", 3), 2: (4, "gizmo", 3), 3: (5, "gizmo", 3), 5: (1, "play station", 1), 7: (6, "lantern", 1)}
    assert {r.product_id for r in hits.where("query_id = 3").collect()} == {1, 2, 5}


def test_spelling_forms_reach_all_near_words(spark):
    """Deletion forms find the terms that a comparison with every term finds."""
    import random

    r = random.Random(2)
    terms = {"".join(r.choices("abcd", k=r.randint(4, 10))) for _ in range(300)}
    asked_ = {"".join(r.choices("abcd", k=r.randint(4, 10))) for _ in range(200)} - terms
    dictionary = spark.createDataFrame([(t, 2 + len(t) % 3) for t in terms], "token string, freq long")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for w in asked_:
        swaps = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        best = [(0, -(2 + len(t) % 3), t) for t in terms & swaps]
        for t in terms:
            d, reach = distance(w, t), 2 if len(w) >= 8 else 1
            if d <= reach and t not in w and (w[0] == t[0] or (len(w) > 6 and d <= 1)):
                best.append((d, -(2 + len(t) % 3), t))
        if best:
            want[w] = min(best)[2]
    got = {x.token: x.correction for x in rewrite.corrections(spark.createDataFrame([(w,) for w in asked_], "token string"), dictionary).collect()}
    assert got == want and len(want) > 20


def test_only_open_queries_meet_all_vectors(spark, monkeypatch):
    queries = asked(spark, "red lamp", "red", "blue lamp", "green lamp", "sku lamp")
    hits = spark.createDataFrame([(1, 10, "text"), (1, 11, "text"), (2, 10, "text"), (3, 10, "text"), (3, 11, "partial"), (5, 10, "sku")], "query_id long, product_id long, match_type string")
    gated = search.answered(queries, hits)
    assert [r.query_id for r in gated.collect()] == [1]
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [1.0, 0.1])], "id long, embedding array<float>")
    embedded = queries.select("query_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    seen, top_k = [], search.top_k
    monkeypatch.setattr(search, "top_k", lambda q, *a: seen.extend(r.query_id for r in q.collect()) or top_k(q, *a))
    got = {}
    for r in search.neighbours(hits, gated, embedded, vectors).collect():
        got.setdefault(r.query_id, set()).add(r.product_id)
    assert sorted(seen) == [2, 3, 4, 5]
    assert got == {1: {10}, 2: {10, 12}, 3: {10, 12}, 4: {10, 12}, 5: {10, 12}}


def test_the_whole_search(spark, shop):
    index, known, alts = shop
    words = lexicon.spell_dictionary(index.products).withColumn("freq", F.lit(5))
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(1, 8)], "id long, embedding array<float>")
    embed = lambda texts: texts.select("query_id", F.array(*(F.lit(float(j == 2)) for j in range(8))).alias("embedding"))
    intents = spark.createDataFrame([("phones", ["Phones"], [])], "term string, categories array<string>, tags array<string>")
    queries = asked(spark, "xiaomi phone", "monitr", "xx1", "fifa ps4", "شیامی")
    out, shown = search.complete_search(index, queries, grouped(spark, ("شیامی", "xiaomi")), words, known, intents, embed, vectors)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.product_id)
    suggested = {r.query_id: (r.did_you_mean, r.applied) for r in shown.collect()}
    # carriers of the brand first, the used one after the new one
    assert got[1][:2] == [1, 6]
    assert suggested[2] == ("monitor", True) and got[2][0] == 2 and got[3][0] == 1 and got[4][0] == 4
    assert {1, 6} <= set(got[5])
