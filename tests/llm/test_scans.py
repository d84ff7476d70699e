import math
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import licenses, pii

KINDS = pii.KINDS


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 14 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TEXTS = [
    "write to a.b@c.de.f@g.hi, +1 (771) 555-1655", "a@b.c_d@e.f x@y@z.com", "1.2.3.4.5.6.7.8 001.02.255.256 0000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "é😀 a@b.co é", "", " +1 2", "9" * 3000 + ".1.1.1", "a." * 3000 + "@b" + ".c" * 9000, "1 " * 5000, "+" * 4000 + "1 23456789012", None,
]


def test_seeds_equal_plain_patterns(table):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.pii_spans(table(rows)).collect()}
    assert got == {i: base(t or "") for i, t in rows}


def test_patterns_find_unseen_identifiers(table):
    rows = [(i, f"please mail me a{i}@x.com now") for i in range(6)] + [(9, "please mail me weird!x@host now"), (10, "do not mail weird!x@host"), (None, "call 12345")]
    docs = table([(i, t, 1) for i, t in rows], "doc_id long, text string, base int")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.pii_spans(docs).collect()}
    assert got[9] == [(15, 0, 27)] and got[10] == [] and got[None] == []
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[9] == "please mail me [EMAIL] now" and clean[None] == "call 12345" and pii.redact(docs).columns == docs.columns


def _shape(t):
    import regex

    return regex.sub(r"(?V1)[\p{L}--a]+", "A", regex.sub(r"\p{Ll}+", "a", re.sub("[0-9]+", "9", t)))


def plain_method(rows):
    """The whole method on plain lists: {id: spans}."""
    found = []
    for i, t in rows:
        t = t or ""
        seeds = base(t)
        ms = list(re.finditer(r"(?<!\S)[^\s0-9@]*[0-9@]\S*(?: [^\s0-9@]*[0-9@]\S*)*", t))
        ends = [0, *(m.end() for m in ms)]
        starts = [*(m.start() for m in ms), len(t)]
        for k, m in enumerate(ms):
            lead = re.match(r"[^\w+(@]*|_*", m[0]).end()
            value = re.sub(r"(?<=[^\W_])[\W_]+$", "", m[0][lead:])
            words = lambda x: [w for w in re.split(r"[\W_]+", x) if w]
            before = ["#" if k else "^", *words(t[ends[k] : starts[k]])]
            after = [*words(t[ends[k + 1] : starts[k + 1]]), "$" if k == len(ms) - 1 else "#"]
            s, left, right = _shape(value), before[-1], after[0]
            pats = {"2 " + " ".join(before[-2:]).lower(), f"l {left.lower()} {s}", f"r {s} {right.lower()}", f"s {_shape(left)} {s} {_shape(right)}"}
            kinds = {x[1] for x in seeds if x[0] < m.end() and x[2] > m.start()}
            found.append((i, pats, value, m.start() + lead, kinds))
    edges = {(p, f[2]) for f in found for p in f[1]}
    of = {}
    for p, v in edges:
        of.setdefault(p, set()).add(v)
    seeds = {(f[2], k): 1.0 for f in found for k in f[4]}
    certain, known, best = {v for v, _ in seeds}, dict(seeds), {}
    while True:
        new = {}
        for p, values in of.items():
            for k in range(4):
                c = [known[v, k] for v in values if (v, k) in known]
                if len(c) >= pii.SUPPORT and (p, k) not in best and round(sum(c) / len(values), 9) >= pii.PRECISION:
                    new[p, k] = round(sum(c) / len(values), 9)
        if not new:
            break
        best |= new
        known = dict(seeds)
        for v in {v for _, v in edges} - certain:
            for k in range(4):
                ps = [min(best[p, k], 0.99) for p in of if v in of[p] and (p, k) in best]
                if ps and re.search(pii.SHAPES[KINDS[k]], v):
                    miss = 1.0
                    for x in ps:
                        miss *= 1 - x
                    known[v, k] = 1 - miss
    out = {i: set(base(t or "")) for i, t in rows}
    for i, pats, value, start, kinds in found:
        for k in range(4):
            if not kinds and any((p, k) in best for p in pats) and re.search(pii.SHAPES[KINDS[k]], value):
                out[i].add((start, k, start + len(value)))
    return {i: sorted(x) for i, x in out.items()}, best


def test_the_method_equals_a_plain_version(table):
    import random

    r, rows = random.Random(4), []
    leads = ["call", "mail me", "card no", "host:", "Phone", "or", "é", "tel", "", "x_y"]
    tails = ["now", "or", ". Thanks", "", ", and"]
    values = [
        lambda: f"+1 771 555 {r.randint(1000, 1012)}", lambda: f"0171 2345{r.randint(10, 30)}", lambda: f"u{r.randint(1, 20)}@x.com", lambda: f"u{r.randint(1, 9)}@host", lambda: f"10.0.0.{r.randint(1, 20)}",
        lambda: f"fe80:0:0:{r.randint(1, 9)}", lambda: r.choice(["4111111111111111", "5555555555554444", "378282246310005", "4111111111111112"]), lambda: str(r.randint(1, 50)), lambda: "v2_,",
    ]
    for i in range(400):
        kind = r.randrange(4)
        parts = [f"{leads[kind] if r.random() < 0.8 else r.choice(leads)} {values[min(8, 2 * kind + (r.random() < 0.3))]() if r.random() < 0.9 else r.choice(values)()} {r.choice(tails)}" for _ in range(r.randint(0, 3))]
        rows.append((i, " ".join(parts)))
    want, best = plain_method(rows)
    got = {x.doc_id: sorted(tuple(s) for s in x.spans) for x in pii.pii_spans(table(rows)).collect()}
    assert got == want and best and sum(map(len, want.values())) > sum(len(base(t)) for _, t in rows)


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_all_good_patterns_are_promoted(spark, table, limit):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03}")
    rows = [(10 * i + j, f"write {word(i)} m{i}x{j}@x.com now") for i in range(230) for j in range(5)]
    rows += [(10 * i + 9, f"write {word(i)} odd{i}!x@host now") for i in range(230)]
    docs = table(rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)  # patterns sent to all tasks, or shuffled
    try:
        assert {r.doc_id for r in pii.pii_spans(docs).where("size(spans) = 0").collect()} == set()
        assert pii.redact(docs).where(~F.col("text").rlike(r"^write [a-j]{3} \[EMAIL\] now$")).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_redaction_of_overlaps_and_odd_rows(table, odd):
    docs = table([*odd, (50, "😀 a@b.co, +1 771 555 1655, 4111 1111 1111 1111, 1.2.3.4 end")])
    out = pii.redact(docs)
    assert out.count() == len(odd) + 1
    text = out.where("doc_id = 50").first().text
    assert text == "😀 [EMAIL], [PHONE], [CARD], [IP] end"
    assert out.where("doc_id = 1").first().text is None
    assert pii.redact(docs.limit(0)).count() == 0


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LICENSED = [
    "Released under the MIT License.", "UNDER THE MIT LICENSE under-the-mit-license", "mit license the under", "Licensed under CC BY-NC 4.0. CC BY NC", "cc by ncx xcc by nc", "éunder the mit license",
    "This work is licensed under the GNU General Public License, version 3.", "the gnu general version 3 public license", "Apache License, Version 2.0 " * 3, "under the mit License 2İ K",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "",
]


def test_base_phrases_equal_brute_force(table, odd):
    rows = [*odd, *((100 + i, t) for i, t in enumerate(LICENSED))]
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in licenses.license_scan(table(rows)).collect())
    assert got == sorted(str((i, *plain_licenses(t))) for i, t in rows)


def test_notices_need_position_and_phrase(table):
    docs = table([(i, t + " filler" * (i % 3)) for i, t in enumerate(LICENSED)] + [(50 + i, f"plain text number {i}") for i in range(30)])
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert got[6].labels == "gpl-3" and got[7].labels == "" and got[10].labels == "bsd" and got[0].labels == "mit" and 0 < got[0].score <= 1
    assert got[55].labels == "" and got[55].score == 0
    assert licenses.license_scan(docs.limit(0)).count() == 0


def plain_labels(rows):
    """{id: (labels, score)} by the method on plain lists."""
    texts = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in rows}
    vocabulary = {w for n in licenses.NOTICES for w in n.text.split()}
    idf = {w: math.log(1 + len(rows) / (1 + sum(w in t for t in texts.values()))) for w in vocabulary}
    out = {}
    for i, t in rows:
        words, labels, score = texts[i], set(plain_licenses(t)[-1].split(",")) - {""}, 0.0
        for n in licenses.NOTICES:
            tw, must = n.text.split(), n.mandatory.split()
            ranked = sorted(set(tw), key=lambda w: (-idf[w], w))
            rare = set(ranked[: ranked.index(sorted(set(must), key=ranked.index)[licenses.AGREE - 1]) + 1])
            k = n.text[: n.text.index(n.mandatory)].count(" ")
            for start in range(-len(tw), len(words)):
                met = [p for p in range(len(tw)) if 0 <= start + p < len(words) and words[start + p] == tw[p]]
                if sum(tw[p] in rare for p in met) >= licenses.AGREE and set(range(k, k + len(must))) <= set(met):
                    labels.add(n.label)
                    score = max(score, sum(idf[tw[p]] for p in met) / sum(idf[w] for w in tw))
        out[i] = (",".join(sorted(labels)), score)
    return out


def test_labels_equal_a_plain_version(table):
    import random

    r, rows = random.Random(6), list(enumerate(LICENSED))
    for i in range(100, 160):
        words = r.choice(licenses.NOTICES).text.split()
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(["the", "x", "license"])
        cut = r.randrange(len(words)) if r.random() < 0.4 else 0
        rows.append((i, " ".join(r.choices(["the", "lorem", "software", "é", "copy"], k=r.randint(0, 9)) + words[cut:]) + r.choice(["", ". Under the MIT license", " gnu affero"])))
    got = {x.doc_id: (x.labels, x.score) for x in licenses.license_scan(table(rows)).collect()}
    want = plain_labels(rows)
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()} and all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
    assert sum(x[0] != "" for x in want.values()) > 40


@pytest.mark.parametrize("documents", [30, 2_000, 10**5, 10**9])
def test_two_licences_in_a_file_whatever_the_corpus(table, monkeypatch, documents):
    """Words that few files hold get rarer as the corpus grows, those of a common licence don't."""
    common = set("licensed under the gnu general public license version 3".split())
    weights = {w: math.log(1 + documents / (1 + (documents / 100 if w in common else 2))) for n in licenses.NOTICES for w in n.text.split()}
    monkeypatch.setattr(licenses, "word_weights", lambda docs, text_col: weights)
    whole = max((n for n in licenses.NOTICES if n.label == "mit"), key=lambda n: len(n.text)).text
    texts = ["Licensed under the GNU General Public License, version 3. No noninfringement.", f"{whole}. Licensed under the GNU General Public License, version 3.", "noninfringement merchantability gnu license"]
    got = {r.doc_id: r.labels for r in licenses.license_scan(table(list(enumerate(texts)))).collect()}
    assert got == {0: "gpl-3", 1: "gpl-3,mit", 2: ""}


def test_clashing_columns(spark, tmp_path):
    rows = [(1, "under the MIT license a@b.co", 5, 6, 7, 8)]
    path = str(tmp_path / "clash")
    spark.createDataFrame(rows, "doc_id long, text string, uid int, key int, w int, hits int").write.parquet(path)
    docs = spark.read.parquet(path)
    assert licenses.license_scan(docs).first().labels == "mit"
    assert [tuple(s) for s in pii.pii_spans(docs).first().base] == [(22, 0, 28)]
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.first().text == "under the MIT license [EMAIL]"


def test_weights_count_all_documents(table):
    docs = table([(i, "the license" if i % 2 else "gnu") for i in range(10)])
    w = licenses.word_weights(docs, "text")
    assert w["the"] == w["gnu"] < w["mozilla"] and docs.where(F.col("text") == "gnu").count() == 5
