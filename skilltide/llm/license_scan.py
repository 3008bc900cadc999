"""License scans by diagonal voting.

All rolling k-grams of words of all texts are hashed and joined to the positions of the same k-grams in
the templates. A match at word d of a text and word t of a template votes for the diagonal d - t, along
which the template would lie. Votes are counted by diagonal; neighbouring diagonals of a template (an
inserted or missing word moves the rest by one) are merged, and a merged span is verified: words are
compared, not hashes, and the template's words that the span covers must be at least ``min_share`` of it.
Templates of at most ``gram`` words are one k-gram of their own length; each place is a span.

Template positions are broadcast if they are at most MAX_POSITIONS rows, else joined by a shuffle. Only
matches are shuffled, once, by text; one text's matches meet in one task. A text is held as the list of
its words. Rows are told apart by their place in the scan, so repeated and null ids stay as they are.
Null and empty texts have no words and no spans; an empty table gives no rows, an empty table of
templates no spans. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skilltide.llm.common import text_or_empty
from skilltide.operators.scale import cut_lineage, fits

# What separates words, in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Phrases whose every place counts, and their labels.
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# The notices that licenses ask to put into files, and their labels.
NOTICES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the
        Software."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version 3 of
        the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice
        appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
        copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/."""),
    ("cc-by", """This work is licensed under the Creative Commons Attribution 4.0 International License. To
        view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"""),
]
GRAM = 4
MIN_SHARE = 0.6
# Diagonals at most this share of a template apart are merged.
SLACK = 1 / 8
MAX_POSITIONS = 100_000
# Stands for the row that keeps a text without matches.
MARK = -1


def default_templates(spark: SparkSession) -> DataFrame:
    rows = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]
    return spark.createDataFrame(rows, "label string, text string, base boolean")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS, -1), "")


def word_columns(list_: str, gram: int) -> list[Column]:
    """The list of words, and the same from its second, third, ... word on."""
    return [F.col(list_) if i == 0 else F.slice(list_, i + 1, F.size(list_)) for i in range(gram)]


def gram_hash(size: int) -> Column:
    """64-bit hash of ``size`` words from ``w0`` on; null where there are fewer."""
    parts = [F.col(f"w{i}") for i in range(size)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(size), *parts))


def gram_words(size: Column, gram: int) -> Column:
    return F.concat_ws(" ", *[F.when(size > i, F.col(f"w{i}")) for i in range(gram)])


def positions(templates: DataFrame, gram: int) -> DataFrame:
    """template, label, base, length, slack, k, t, hash and words of every k-gram of every template."""
    shifted = (templates.select("template", "label", "base", words(F.col("text")).alias("list"))
               .filter(F.size("list") > 0).withColumn("length", F.size("list")))
    for i, column in enumerate(word_columns("list", gram)):
        shifted = shifted.withColumn(f"w{i}", column)
    each = (shifted.select("template", "label", "base", "length",
                           F.posexplode(F.arrays_zip(*[f"w{i}" for i in range(gram)])).alias("t", "z"))
            .select("template", "label", "base", "length", "t", "z.*")
            .withColumn("k", F.least(F.lit(gram), F.col("length")))
            .filter(F.col("t") + F.col("k") <= F.col("length")))
    of_size = F.coalesce(*[F.when(F.col("k") == n, gram_hash(n)) for n in range(1, gram + 1)])
    slack = F.when(F.col("length") <= gram, 0).otherwise(F.floor(F.col("length") * SLACK)).cast("int")
    return each.select("template", "label", "base", "length", slack.alias("slack"), "k", "t",
                       of_size.alias("hash"), gram_words(F.col("k"), gram).alias("gram"))


def license_spans(df: DataFrame, templates: DataFrame | None = None, *, id: str = "doc_id",
                  text: str = "text", gram: int = GRAM, min_share: float = MIN_SHARE) -> DataFrame:
    """Per row: id, n_words, spans (template, label, base, start, stop, covered, length), by start.

    ``templates`` has label, text and base (each place of a base template of at most ``gram`` words is
    a span). Rows of it with a null label or text count as no template."""
    spark = df.sparkSession
    given = default_templates(spark) if templates is None else templates
    numbered = (given.filter("label IS NOT NULL AND text IS NOT NULL")
                .select("label", "text", F.coalesce("base", F.lit(False)).alias("base"))
                .withColumn("template", F.xxhash64("label", "text") % (1 << 62)).distinct())
    at = cut_lineage(positions(numbered, gram))
    sizes = sorted(r["k"] for r in at.select("k").distinct().collect())
    bounded = fits(at, MAX_POSITIONS)

    listed = df.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"),
                       words(text_or_empty(text)).alias("list"))
    for i, column in enumerate(word_columns("list", gram)):
        listed = listed.withColumn(f"w{i}", column)
    zipped = F.arrays_zip(*[f"w{i}" for i in range(gram)])
    mark = F.array(F.struct(*[F.lit(None).cast("string").alias(f"w{i}") for i in range(gram)]))
    grams = listed.select("row", "id", F.size("list").alias("n_words"),
                          F.posexplode(F.concat(mark, zipped)).alias("place", "z")).select(
        "row", "id", "n_words", (F.col("place") - 1).alias("d"), "z.*")
    hashes = [F.struct(F.lit(n).alias("k"), gram_hash(n).alias("hash")) for n in sizes]
    first = F.struct(F.lit(MARK).alias("k"), F.when(F.col("d") < 0, F.lit(MARK).cast("bigint")).alias("hash"))
    hashed = (grams.withColumn("h", F.explode(F.array(first, *hashes)))
              .filter("h.hash IS NOT NULL")
              .select("row", "id", "n_words", "d", F.col("h.k").alias("of"), F.col("h.hash").alias("hash_"),
                      *[f"w{i}" for i in range(gram)]))
    kept = at.limit(0).unionByName(spark.createDataFrame(
        [(MARK, None, False, 0, 0, MARK, 0, MARK, "")], at.schema)).unionByName(at)
    joined = hashed.join(
        F.broadcast(kept) if bounded else kept,
        (F.col("hash_") == F.col("hash")) & (F.col("of") == F.col("k"))
        & (gram_words(F.col("of"), gram) == F.col("gram")))
    votes = (joined.select("row", "id", "n_words", "template", "label", "base", "length", "slack", "k", "t",
                           (F.col("d") - F.col("t")).alias("diagonal"))
             .repartition("row")
             .groupBy("row", "id", "n_words", "template", "label", "base", "length", "slack", "k", "diagonal")
             .agg(F.collect_list("t").alias("ts")))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("slack"), F.lit(True))
    spans = votes.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(along))
    covered = F.explode(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.greatest("k", F.lit(1)) - 1))))
    place = (spans.select("row", "id", "n_words", "template", "label", "base", "length", "span", "diagonal",
                          covered.alias("word"))
             .groupBy("row", "id", "n_words", "template", "label", "base", "length", "span", "word")
             .agg(F.min(F.col("diagonal") + F.col("word")).alias("low"),
                  F.max(F.col("diagonal") + F.col("word")).alias("high")))
    found = (place.groupBy("row", "id", "n_words", "template", "label", "base", "length", "span")
             .agg(F.min("low").alias("start"), (F.max("high") + 1).alias("stop"),
                  F.count("*").cast("int").alias("covered")))
    verified = (F.col("template") != MARK) & (F.col("covered") >= F.col("length") * min_share)
    span = F.struct("start", "stop", "label", "base", "covered", "length", "template")
    return (found.groupBy("row", "id", "n_words")
            .agg(F.sort_array(F.collect_list(F.when(verified, span))).alias("spans"))
            .select(F.col("id").alias(id), F.col("n_words").cast("bigint").alias("n_words"), "spans"))
