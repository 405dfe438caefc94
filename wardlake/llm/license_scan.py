"""License scans: licence names by phrase, licence texts by diagonal voting.

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` (digits, a-z and all
non-ASCII code points). Null texts count as empty.

Base: every place where a phrase's words stand consecutively (``PHRASES``); its label is listed.

Method (diagonal voting): every rolling K-word gram of every text is hashed and joined to the
gram positions of licence templates (a fixed, small table, broadcast). A vote (text word i,
template word j) lies on diagonal i - j; votes are counted per (text, template, diagonal), and
diagonals at most ``DIAGONAL_GAP`` apart merge into one alignment (words inserted or left out).
An alignment is verified when it holds at least ``MIN_COVERAGE`` of the template's distinct grams
and its span in the text is at most twice the template's length; a verified alignment adds the
template's label. ``score`` is the best coverage of any alignment of the text (0 without one).

Edge cases: null or empty text: no words, no places, no labels, score 0; first_word and
last_word are null without a base place; rows are keyed by doc_id and a digest of the text, so
repeated rows give equal results and each its own row, and rows that share a doc_id but not the
text are scored apart; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlake.llm.common import LOWER, UPPER, digest

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 4
DIAGONAL_GAP = 4
MIN_COVERAGE = 0.6

# The contract's phrases and their labels, in its order.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Licence templates (public notice texts) and the labels the method adds.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not '
                   "use this file except in compliance with the License. You may obtain a copy "
                   "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
                   "by applicable law or agreed to in writing, software distributed under the "
                   'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
                   "OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
            'this software and associated documentation files (the "Software"), to deal in the '
            "Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject "
            "to the following conditions: The above copyright notice and this permission notice "
            "shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later "
                "version. This program is distributed in the hope that it will be useful, but "
                "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
                "FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation; either version 2 of the License, or (at your option) any later "
                "version."),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are "
                     "met: Redistributions of source code must retain the above copyright "
                     "notice, this list of conditions and the following disclaimer."),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER),
                                F.lit(WORD), F.lit(0))


def places(w: Column, phrase: str) -> Column:
    """0-based starts of the phrase's words in ``w``."""
    parts = phrase.split()
    n = len(parts)

    def here(i: Column) -> Column:
        test = F.get(w, i) == parts[0]
        for at, part in enumerate(parts[1:], 1):
            test = test & (F.get(w, i + at) == part)
        return test

    return F.when(F.size(w) >= n, F.filter(F.sequence(F.lit(0), F.size(w) - n), here)) \
        .otherwise(F.array().cast("array<int>"))


def grams(w: Column) -> Column:
    """Hashes of the rolling K-word grams, by start."""
    return F.when(F.size(w) >= K, F.transform(
        F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(F.slice(w, i + 1, K)))) \
        .otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(t for t in TEMPLATES)),
                                 "tid int, t struct<label:string,text:string>")
    w = words(F.col("t.text"))
    return rows.select("tid", F.col("t.label").alias("label"),
                       (F.size(w) - K + 1).alias("n_grams"),
                       F.posexplode(grams(w)).alias("j", "h"))


def base(docs: DataFrame) -> DataFrame:
    w = F.col("w")
    found = [places(w, phrase) for phrase, _ in PHRASES]
    starts = F.concat(*found)
    labels = F.array_compact(F.array(*(F.when(F.size(f) > 0, F.lit(label))
                                       for f, (_, label) in zip(found, PHRASES))))
    return docs.select("doc_id", "key", "w").select(
        "doc_id", "key", F.size(w).cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_sort(labels).alias("base"))


def alignments(docs: DataFrame) -> DataFrame:
    """Per (text key, template, alignment): coverage, span and whether it is verified."""
    templates = template_grams(docs.sparkSession)
    votes = docs.select("key", F.posexplode(grams(F.col("w"))).alias("i", "h")) \
        .join(F.broadcast(templates), "h")
    per_diagonal = votes.groupBy("key", "tid", "label", "n_grams",
                                 (F.col("i") - F.col("j")).alias("d")).agg(
        F.collect_set("j").alias("js"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    order = Window.partitionBy("key", "tid").orderBy("d")
    merged = per_diagonal.withColumn(
        "new", F.when(F.col("d") - F.lag("d").over(order) <= DIAGONAL_GAP, 0).otherwise(1))
    merged = merged.withColumn("alignment", F.sum("new").over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.groupBy("key", "tid", "label", "n_grams", "alignment").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("js")))).alias("matched"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    coverage = F.col("matched") / F.col("n_grams")
    span = F.col("hi") + K - F.col("lo")
    return found.select("key", "label", coverage.alias("coverage"),
                        ((coverage >= MIN_COVERAGE) & (span <= 2 * (F.col("n_grams") + K - 1)))
                        .alias("verified"))


def license_scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    found (the method's labels)."""
    keyed = docs.select("doc_id", "text").select(
        "doc_id", F.struct(F.col("doc_id"), *digest(F.coalesce("text", F.lit("")))).alias("key"),
        words(F.col("text")).alias("w"))
    rows = base(keyed)
    by_key = alignments(keyed).groupBy("key").agg(
        F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("label")))).alias("found"),
        F.max("coverage").alias("score"))
    out = rows.join(by_key, rows["key"].eqNullSafe(by_key["key"]), "left").drop(by_key["key"])
    found = F.coalesce(F.col("found"), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", found))), ",").alias("labels"),
        F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("score"),
        F.array_join(found, ",").alias("found"))
