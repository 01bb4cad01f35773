"""License scans by diagonal voting, with DataFrame functions alone.

Every rolling k-gram of words of every document is hashed and joined to the positions of the license
templates that hold the same k-gram (the words are compared too). A match at word p of the document and
word t of the template votes for the diagonal p - t. Votes are summed by diagonal; neighbouring diagonals
(words were put in or left out) merge; a span counts as found if it lacks no more of the template's k-grams
than a changed word in eight can break. Votes are aggregated inside each task first, so what is shuffled is a row per document and match.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3

#: Phrases that count wherever their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices that are also found when some of their words differ.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial 4 0 international": "cc-by-nc",
    "creative commons attribution sharealike 4 0 international": "cc-by-sa",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "gnu affero general public license version 3": "agpl-3",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
}

#: Wording of licences that is longer than a notice.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license": "apache-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": "mpl-2",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
}

#: A text is cut into parts of so many k-grams at most, each a template of its own; merged diagonals may be SLACK apart.
PART, SLACK = 48, 3

#: A span counts if it lacks no more of a template's k-grams than a few changed words can break, one change for each
#: PER_CHANGE words; of shorter templates COVERAGE of them must be there.
PER_CHANGE, COVERAGE = 8, 0.8

WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words in lower case. lower() folds more than A-Z, but of what it turns into ASCII letters alone
    (the Kelvin sign) nothing is left, so ASCII words come out as they should."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ß")))
    return F.filter(F.split(plain, WORD_BREAKS), lambda w: w != "")


def template_rows() -> list[tuple]:
    """A row for each k-gram: template, label, base, how many k-grams the template has, how many of them must be there,
    the place, its bit, and the words."""
    parts = [(t.split(), x, True) for t, x in PHRASES.items()]
    for text, label in [*NOTICES.items(), *TEXTS.items()]:
        w = text.split()
        many = -(-(len(w) - K + 1) // PART)
        size = -(-len(w) // many)
        parts += [(w[at : at + size + K - 1], label, False) for at in range(0, len(w), size) if len(w) - at >= K]
    rows = []
    for number, (w, label, base) in enumerate(parts):
        grams = len(w) - K + 1
        least = grams - K * (len(w) // PER_CHANGE) if len(w) >= PER_CHANGE else math.ceil(COVERAGE * grams)
        least = grams if base else max(least, grams // 2)
        rows += [(number, label, base, grams, least, at, 1 << at, *w[at : at + K]) for at in range(grams)]
    return rows


def _templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(template_rows(), "template int, label string, base boolean, grams int, least int, at int, bit long, t1 string, t2 string, t3 string")
    return rows.withColumn("h", F.xxhash64("t1", "t2", "t3"))


def scan_spans(docs: DataFrame) -> DataFrame:
    """One row per document and diagonal with votes, and one without template per document: row, doc_id,
    n_words, template, label, base, grams, diagonal, votes, first, last (k-gram starts), seen (bit set of
    template positions)."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    w, size = F.col("w"), F.size("w")
    grams = numbered.select("row", "doc_id", size.alias("n_words"), F.posexplode_outer(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(size, F.lit(1))).alias("b"), F.slice(w, 3, F.greatest(size, F.lit(1))).alias("c"))).alias("p", "g"))
    grams = grams.select("row", "doc_id", "n_words", "p", F.col("g.a").alias("a"), F.col("g.b").alias("b"), F.col("g.c").alias("c")).withColumn("h", F.xxhash64("a", "b", "c"))
    t = F.broadcast(_templates(docs.sparkSession).alias("t"))  # a fixed list
    hit = (F.col("t.h") == grams.h) & (F.col("t.t1") == grams.a) & (F.col("t.t2") == grams.b) & (F.col("t.t3") == grams.c)
    votes = grams.join(t, hit, "left").withColumn("diagonal", F.col("p") - F.col("at"))
    return votes.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "least", "diagonal").agg(
        F.count("at").alias("votes"), F.min("p").alias("first"), F.max("p").alias("last"), F.bit_or("bit").alias("seen")
    )


def license_scan(docs: DataFrame) -> DataFrame:
    """Licenses named in each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of PHRASES, first_word and last_word are the smallest and largest start.
    labels also has those of NOTICES and TEXTS (any part of them) of which enough k-grams are there, see PER_CHANGE. score is 1 if a phrase
    was found, else the largest share found of a notice that counts, else 0. Null text is empty: no
    words, empty labels, score 0. Rows are told apart by their place, so repeated or null ids are kept
    apart; other columns are ignored.
    """
    spans = scan_spans(docs)
    order = Window.partitionBy("row", "template").orderBy("diagonal", "first")
    near = F.col("diagonal") - F.lag("diagonal").over(order) <= SLACK
    close = F.abs(F.col("first") - F.lag("last").over(order)) <= F.col("grams") + 2 * K
    spans = spans.withColumn("chain", F.sum(F.when(near & close, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col("base") & (F.col("votes") == F.col("grams"))
    merged = spans.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "least", "chain").agg(
        F.bit_count(F.bit_or("seen")).alias("covered"), F.count(F.when(place, 1)).alias("places"), F.min(F.when(place, F.col("diagonal"))).alias("start"), F.max(F.when(place, F.col("diagonal"))).alias("end")
    )
    share = F.when(~F.col("base"), F.col("covered") / F.col("grams"))
    noticed = ~F.col("base") & (F.col("covered") >= F.col("least"))
    base_hit = F.col("places") > 0

    def label_list(*conditions):
        found = F.when(conditions[0], F.col("label"))
        for c in conditions[1:]:
            found = F.when(c, F.col("label")).otherwise(found)
        return F.array_join(F.array_sort(F.collect_set(found)), ",")

    return merged.groupBy("row", "doc_id", "n_words").agg(
        F.sum("places").alias("n_base"),
        F.min("start").cast("long").alias("first_word"),
        F.max("end").cast("long").alias("last_word"),
        label_list(base_hit).alias("base_labels"),
        label_list(noticed, base_hit).alias("labels"),
        F.coalesce(F.max(F.when(base_hit, 1.0).when(noticed, share)), F.lit(0.0)).alias("score"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
