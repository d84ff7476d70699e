"""Divergence of sources, importance resampling, token counts: against brute force and the libraries."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import divergence, resampling, token_counts
from lodestar.llm.registry import QUERIES, SQL
from lodestar.llm.tokens import vocabulary

DOCS = "doc_id long, text string, lang string, source string"


def shares_of(docs, least):
    """The definition of the audit, term by term and pair by pair."""
    rows = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in (text or "")))) for _, text, lang, source in docs]
    df, counts, groups = Counter(), Counter(), {(r[0], r[1]) for r in rows}
    for lang, source, terms in rows:
        df.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept, sources = [t for (x, t), n in df.items() if x == lang and n >= least], [s for x, s in groups if x == lang]

        def share(some):
            n = {t: sum(counts[lang, s, t] for s in some) for t in kept}
            return {t: 1 + (10**9 * (n[t] + 5)) // (sum(n.values()) + 5 * len(kept)) for t in kept}

        q, p = share(sources), {s: share([s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t])
            out |= {(lang, s, part, item.decode(), -v, i) for part, rows_ in (("pair", pairs), ("term", terms[: divergence.TOP])) for i, (v, item) in enumerate(rows_, 1)}
    return out


@pytest.mark.parametrize("blocks", [1, None])
def test_divergence_equals_brute_force(spark, table, blocks):
    random = np.random.RandomState(3)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("a", "É", "ö", "ß")]
    rows = [(i, " ".join(random.choice(words[: 4 + 3 * (i % 12)], random.randint(0, 30))) + (" Hot" * 40 if i % 3 == 0 else ""), ["x", "y", None][i % 3], ["hot", "hot", f"s{i % 5}", None][i % 4]) for i in range(400)]
    rows += [(1, None, "x", "only nulls"), (2, "", "x", "only nulls"), (None, "ba " * 50_000, "z", "long"), (3, "A-B_c'd9é", "z", "long"), rows[7], rows[7]]
    docs = table(rows, DOCS)
    want = shares_of(rows, 5)
    got = [tuple(r) for r in divergence.divergence(docs, least=5, blocks=blocks).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r[2] for r in got} == {"pair", "term"}


def test_sketch_never_underestimates(spark, table):
    docs = table([(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}" for j in range(i)), "x", "s") for i in range(0, 400, 7)], DOCS)
    counters = {(r.block, r.counter): r.n for r in divergence.sketch(docs, 1).collect()}
    each = divergence._counted(docs, exact=True).groupBy("lang", "term").sum("documents").withColumnRenamed("sum(documents)", "n")
    rows = each.select("n", divergence._block(1).alias("block"), divergence.F.array(*divergence._counters()).alias("counters")).collect()
    assert rows and all(min(counters[r.block, c] for c in r.counters) >= r.n for r in rows)


def test_divergence_of_nothing_and_clashing_names(spark, table):
    assert divergence.divergence(table([], DOCS)).count() == 0
    one = table([(i, "same words", "x", "s") for i in range(40)], DOCS)
    assert [tuple(r) for r in divergence.divergence(one).collect()] == []
    extra = table([(i, "same words" if i % 2 else "same", "x", "st"[i % 2], 1, 2, 3) for i in range(80)], DOCS + ", term int, n int, block int")
    assert {(r.source, r.part, r.item) for r in divergence.divergence(extra).collect()} == {("s", "pair", "t"), ("t", "pair", "s"), ("t", "term", "words"), ("s", "term", "same")}


def features_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in (text or "")))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def resampled(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for text in texts for f in features_of(text)[1]) for texts in ([d[1] for d in docs], target))
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)}
    out = []
    for doc_id, text in docs:
        words, features = features_of(text)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling_equals_brute_force(spark, table, odd):
    random = np.random.RandomState(5)
    words = [f"w{i}" for i in range(200)] + ["É", "été", "x_y", "A1"]
    docs = [(i + 100, " ".join(random.choice(words, random.randint(0, 60)))) for i in range(300)] + odd + [(7, "a\0b C"), (8, "one " * 19), (9, "one " * 20)]
    target = ["w1 w2 w3 été", None, "", "w1 w2"]
    got = resampling.resample(table(docs), table([(t,) for t in target], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(docs, target)


def test_resampling_of_nothing(spark, table):
    empty, target = table([]), table([("a b",)], "text string")
    assert resampling.resample(empty, target).count() == 0
    rows = resampling.resample(table([(1, "a b", 5)], "doc_id long, text string, bucket int"), table([], "text string")).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in rows] == [(1, 3, None)]


def test_ranks_do_not_depend_on_partitions(spark, table):
    docs, target = table([(i % 40, f"word{i % 7} " * 25) for i in range(200)]), table([("word1 word2",)], "text string")
    want = sorted((r.doc_id, r.score, r["rank"]) for r in resampling.resample(docs, target).collect() if r["rank"])
    assert [r[2] for r in sorted(want, key=lambda r: r[2])] == list(range(1, 51))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = sorted((r.doc_id, r.score, r["rank"]) for r in resampling.resample(docs, target).collect() if r["rank"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == want


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(token_counts.PIECES))


def test_cuts_keep_the_counts(library):
    counter, random = token_counts.counter(vocabulary(token_counts.PIECES)), np.random.RandomState(11)
    parts = ["a", "the", " ", "  ", "\n", "\t", "▁", "▁▁", "é", "日本", "🙂", "\0", "<s>", "</s>", "<unk>", "<0x41>", ".", "12", "xyzzy", ";\r", "don't", "a1b2", "».", "ß̈", "क्षि", "٣٤", "_x_", "²", "　", "​", "ﬁ"]
    texts = ["", " ", "▁", "a ", " a", "\n ", *("".join(random.choice(parts, random.randint(1, 40))) for _ in range(6000))]
    assert [sum(counter.counts(counter.cut(t))) for t in texts] == [len(x) for x in library.encode(texts)]


@pytest.mark.parametrize("hot", [0, 3, token_counts.HOT])
def test_token_counts_equal_the_library(spark, table, library, odd, hot):
    rows = [*odd, (20, "x" * 200_000), (21, "hot " * 5000), (22, "Ünïcödé 日本語 🙂 " * 300)]
    got = token_counts.token_counts(table(rows), vocabulary(token_counts.PIECES), hot=hot)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_token_counts_of_nothing_and_clashing_names(spark, table):
    path = vocabulary(token_counts.PIECES)
    assert token_counts.token_counts(table([]), path).count() == 0
    rows = token_counts.token_counts(table([(1, "a b", 9, 9, 9)], "doc_id long, text string, part int, n int, uid int"), path).collect()
    assert [tuple(r) for r in rows] == [(1, 3, 2, False)]


def test_all_documents_by_the_library(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_token_counts"](spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in docs.items()} and len(got) == len(docs)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_importance_resampling"])
def test_equals_duckdb(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf), duck.execute(SQL[name])
    order = [d[0] for d in want.description]
    assert sorted((tuple(r) for r in got.select(order).collect()), key=str) == sorted(want.fetchall(), key=str)
