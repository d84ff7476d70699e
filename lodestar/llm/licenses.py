r"""License scans by a positional rare-token index, with DataFrame functions only.

1. The document frequency of every word of the templates below (notices and licence texts) is counted
   over all documents; that gives the words' IDF.
2. The index lists for every word its places in the templates. For each template, a document is looked
   up by its own words of it from the highest IDF down to where ``AGREE`` words of the mandatory phrase
   are among them, so that what else the document holds, and how rare words get as the corpus grows,
   can't hide a phrase. Their postings are intersected by relative position: ``AGREE`` places must
   imply the same start of the template.
3. A template is reported where its mandatory phrase stands word for word at such a start.

Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ref, stored, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
AGREE = 2
#: Phrases that are always reported, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    mandatory: str


#: The sentences by which licences are commonly declared, and whole licence texts, as words, and the part that must be there.
NOTICES = (
    Notice("mit", "released under the mit license", "under the mit license"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge to any person"),
    Notice("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Notice("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Notice("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Notice("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Notice("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Notice("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Notice(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection "
        "with the software or the use or other dealings in the software",
        "shall be included in all copies or substantial portions of the software",
    ),
    Notice(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Notice(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "are permitted provided that the following conditions are met",
    ),
    Notice(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "permission is granted to anyone to use this software for any purpose",
    ),
    Notice(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "unless required by applicable law or agreed to in writing",
    ),
    Notice(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gnu general public license as published by the free software foundation",
    ),
    Notice(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
)


def _lower_ascii(text: Column) -> Column:
    """Lower case of A-Z. Two other letters have lower cases with ASCII in them and are kept as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.when(odd, F.translate(text, upper, lower)).otherwise(F.lower(text))


def _words(text: Column) -> Column:
    """The words, each followed by one space, after one leading space."""
    spaced = F.regexp_replace(_lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " ")
    trimmed = F.trim(spaced)
    return F.when(trimmed == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), trimmed, F.lit(" ")))


def _count_words(spaced: Column) -> Column:
    """Words in a text whose words are each followed by one space, or each preceded by one."""
    return (F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))).cast("long")


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def word_weights(docs: DataFrame, text_col: str) -> dict[str, float]:
    """ln(1 + documents / (1 + documents with the word)) of every template word, over all documents."""
    vocabulary = sorted({w for n in NOTICES for w in n.text.split()})
    found = docs.select(F.explode(F.array_intersect(_literals(vocabulary), F.split(_words(ref(text_col)), " "))).alias("word"))
    df = dict(found.groupBy("word").count().collect())  # a row for each template word at most
    rows = docs.count()
    return {w: math.log(1 + rows / (1 + df.get(w, 0))) for w in vocabulary}


def _index(weights: dict[str, float]) -> list[tuple]:
    """(word, notice, place, rare, mandatory, weight share) of every word of every template."""
    rows = []
    for i, n in enumerate(NOTICES):
        words, must = n.text.split(), n.mandatory.split()
        at = next(p for p in range(len(words)) if words[p : p + len(must)] == must)
        total = sum(weights[w] for w in words) or 1.0  # without documents nothing weighs
        ranked = sorted(set(words), key=lambda w: (-weights[w], w))  # rarest first
        rare = set(ranked[: [k for k, w in enumerate(ranked, 1) if w in must][AGREE - 1]])
        rows += [(w, i, p, int(w in rare), int(at <= p < at + len(must)), weights[w] / total) for p, w in enumerate(words)]
    return rows


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share, by weight, of a template's words that stand at their places around a
    verified phrase; 0 without one. Null texts are empty: no words, no labels (empty strings), null
    first and last word. Rows with null or equal ids stay rows of their own.
    """
    spark = docs.sparkSession
    weights = word_weights(docs, text_col)
    scan = docs.select(ref(id_col).alias("doc_id"), _words(ref(text_col)).alias("w"))
    w = F.col("w")
    padded = [(f" {phrase} ", len(phrase.split()), label) for phrase, label in BASE]
    places = [F.when(F.contains(w, F.lit(p)), F.regexp_count(w, F.lit(f"{p[:-1]}(?= )"))).otherwise(0).cast("long") for p, _, _ in padded]
    n_words = F.greatest(_count_words(w) - 1, F.lit(0).cast("long"))
    first = [F.when(F.contains(w, F.lit(p)), _count_words(F.substring_index(w, p, 1))) for p, _, _ in padded]
    last = [F.when(F.contains(w, F.lit(p)), n_words - _count_words(F.substring_index(w, p, -1)) - k) for p, k, _ in padded]
    labels = F.array_compact(F.array(*(F.when(F.contains(w, F.lit(p)), F.lit(label)) for p, _, label in padded)))
    own = F.array_intersect(_literals(sorted(weights)), F.split(F.trim(w), " "))
    scan = scan.select(
        "doc_id", "w", n_words.alias("n_words"), sum(places[1:], places[0]).alias("n_base"), F.least(*first).alias("first_word"),
        F.greatest(*last).alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("base"), own.alias("own"),
    )
    likely = F.lit(False)
    for must in sorted({tuple(sorted(set(n.mandatory.split()))) for n in NOTICES}):
        # without the words of its phrase a template can't be verified
        likely = likely | (F.size(F.array_intersect(F.col("own"), _literals(must))) == len(must))
    words = F.transform(F.split(F.trim(w), " "), lambda x, i: F.struct(x.alias("word"), i.alias("at")))
    hits = F.when(likely, F.filter(words, lambda s: F.array_contains("own", s["word"])))
    # stored without the texts: a few numbers a document, and word places of likely ones
    kept = stored(scan.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_words", "n_base", "first_word", "last_word", "base", hits.alias("hits")), "license-hits")
    index = spark.createDataFrame(_index(weights), "word string, notice int, place int, rare int, mandatory int, share double")  # as many rows as the templates have words
    found = kept.where(F.col("hits").isNotNull()).select("uid", F.inline("hits"))
    starts = found.join(F.broadcast(index), "word").groupBy("uid", "notice", (F.col("at") - F.col("place")).alias("start"))
    starts = starts.agg(F.sum("rare").alias("agreeing"), F.sum("mandatory").alias("mandatory"), F.sum("share").alias("share"))
    needs = spark.createDataFrame([(i, len(n.mandatory.split()), n.label) for i, n in enumerate(NOTICES)], "notice int, need int, label string")
    verified = starts.join(F.broadcast(needs), "notice").where((F.col("mandatory") == F.col("need")) & (F.col("agreeing") >= AGREE))
    # rounded: the sum of shares comes in any order
    per_doc = verified.groupBy("uid").agg(F.collect_set("label").alias("more"), F.round(F.max("share"), 9).alias("score"))
    joined = kept.drop("hits").join(per_doc, "uid", "left")
    every = F.array_sort(F.array_union(F.col("base"), F.coalesce(F.col("more"), F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.least(F.coalesce(F.col("score"), F.lit(0.0)), F.lit(1.0)).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license labels of every whole text of ``documents``."""
    return license_scan(table(spark, sf_dir, "documents"))
