"""Licence notices found by a trained paragraph classifier, on DataFrame functions throughout.

A paragraph is a block of lines between lines without a letter or digit; comment marks and line
breaks part words and are no words. A notice may stand on any run of a paragraph's lines, however wrapped. The features are
the distinct runs of two and of three words that occur in some notice of ``NOTICES``; a multinomial
logistic regression with an l1 penalty, which leaves most weights at zero, says which family a run of
lines belongs to. It learns from the notices (whole, and cut short at either end) and from ordinary
lines of the corpus as the class "unknown". On ordinary lines kept apart, the threshold is calibrated
that a family's probability must exceed. A prediction counts when the lines also share ``SIMILAR``
of the word runs of one of the family's notices.

Runs of lines begin and end where word runs of notices do, at most ``SPAN`` words apart, or are one line. Of those that
overlap and hold the same notice or its kin (notices that share half of their word runs) the one with the
largest share counts, then the shortest, then the first.

Word runs of all paragraphs meet the weights in a broadcast join: the weights are as many as the
word runs of the notices, whatever the corpus. Only runs that occur in notices go on to the sums.

A finding needs ``SIMILAR`` of a notice's word runs, so its lines hold one of a few key words,
chosen such that the runs without them are fewer than that in every notice. Texts and paragraphs
without a key word can hold no finding and are passed over before they are taken apart.

The classifier learns from and is calibrated on all distinct lines of all texts; those that share ``SIMILAR`` / 2 of a notice are
left out. Of a line only the runs that occur in notices count, and lines with the same ones are one row with a weight.

Results for odd input: a null or empty text has no paragraphs and no findings; a paragraph of one
word has no features; a notice that repeats is found each time, also in rows that repeat an id;
of families equally probable the first by name counts; an empty table gives an empty result;
columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .registry import query, table

UNKNOWN = "unknown"
APART = 8  # one ordinary line in so many calibrates
SALTS = 64
TASK_ROWS = 50_000  # rows of the regression that one task holds
SIMILAR = 0.6
FALSE_SHARE = 0.001  # of ordinary paragraphs that may exceed the threshold
LEAST_PROBABILITY = 0.5

# fixed values: opening words of notices in common use, by family
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
             "Licensed under the GNU Affero General Public License, version 3.",
             "This work is licensed under the GNU Affero General Public License, version 3."],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "Licensed under the Apache License, Version 2.0.",
               "Released under the Apache License 2.0.",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Licensed under the 3-Clause BSD License.",
            "Released under the BSD License.",
            "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "Released under CC0 1.0 Universal public domain dedication."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation",
            "This work is licensed under the GNU General Public License, version 3.",
            "Licensed under the GNU General Public License, version 2.",
            "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
             "Licensed under the GNU Lesser General Public License, version 3.",
             "This work is licensed under the GNU Lesser General Public License, version 3."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "Released under the MIT License.",
            "Licensed under the MIT License."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Licensed under the Mozilla Public License, version 2.0."],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without written permission of the copyright holder.",
                    "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


# words from the first run of a notice to its last at most; notices with words put in have room
SPAN = 2 * max(len(text.split()) for texts in NOTICES.values() for text in texts)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_runs(paragraph: Column) -> Column:
    """The distinct runs of two and three words of a paragraph, as strings."""
    words = _words(paragraph)

    def runs(n: int) -> Column:
        return F.arrays_zip(*[F.slice(words, i + 1, F.greatest(F.size(words) - n + 1, F.lit(0))).alias(f"w{i}") for i in range(n)])

    def joined(n: int) -> Column:
        return F.transform(runs(n), lambda r: F.concat_ws(" ", *[r[f"w{i}"] for i in range(n)]))

    return F.array_distinct(F.concat(joined(2), joined(3)))


def lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """paragraph: every line of the texts."""
    return docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("paragraph"))


def paragraphs(docs: DataFrame, may, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a number of its own), first (line) and paragraph of the blocks of lines that ``may`` lets pass."""
    between = r"\n[^\p{L}\p{N}]*\n"
    feeds = lambda parts, i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    parts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.split(text_col, between, -1).alias("blocks"),
                        F.regexp_extract_all(text_col, F.lit(between), F.lit(0)).alias("gaps"))
    some = F.filter(F.transform("blocks", lambda x, i: F.struct(i.alias("at"), x.alias("paragraph"))), lambda x: may(x["paragraph"]))
    placed = F.transform(some, lambda x: F.struct((feeds(F.col("blocks"), x["at"]) + feeds(F.col("gaps"), x["at"])).alias("first"),
                                                  x["paragraph"].alias("paragraph")))
    return parts.select("doc_id", "row", F.explode(placed).alias("block")).select("doc_id", "row", "block.first", "block.paragraph")


def placed_runs(blocks: DataFrame) -> DataFrame:
    """doc_id, row, first (as in ``blocks``), run, at (number of its first word), start and stop (lines of its first and last word)."""
    own = F.split("paragraph", "\n")
    word = F.flatten(F.transform(own, lambda line, i: F.transform(_words(F.regexp_replace(line, r"^(?i)[^\p{L}\p{N}]*(rem|dnl)\b", "")),
                                                                  lambda w: F.struct(w.alias("w"), i.alias("line")))))
    cut = blocks.select("doc_id", "row", "first", word.alias("words"))

    def runs(n: int) -> Column:
        zipped = F.arrays_zip(*[F.slice("words", i + 1, F.greatest(F.size("words") - n + 1, F.lit(0))).alias(f"w{i}") for i in range(n)])
        return F.transform(zipped, lambda r, i: F.struct(F.concat_ws(" ", *[r[f"w{k}"]["w"] for k in range(n)]).alias("run"), i.alias("at"),
                                                         (F.col("first") + r["w0"]["line"]).alias("start"), (F.col("first") + r[f"w{n - 1}"]["line"]).alias("stop")))

    return cut.select("doc_id", "row", "first", F.explode(F.concat(runs(2), runs(3))).alias("r")).select("doc_id", "row", "first", "r.*")


def notices(spark: SparkSession) -> DataFrame:
    """family, notice (its number), paragraph; a row per notice of ``NOTICES``."""
    listed = [(family, text) for family, texts in sorted(NOTICES.items()) for text in texts]
    return spark.createDataFrame([(f, i, t) for i, (f, t) in enumerate(listed)], "family string, notice int, paragraph string")


def notice_runs(spark: SparkSession) -> DataFrame:
    """notice, family, run, runs: the word runs of each notice and how many it has."""
    made = notices(spark).withColumn("all", word_runs(F.col("paragraph")))
    return made.select("notice", "family", F.explode("all").alias("run"), F.size("all").alias("runs"))


def _plain_runs(text: str) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i:i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


def key_words(similar: float) -> list[str]:
    """Words of which a text with ``similar`` of some notice's runs has one; rare-looking (long) words first."""
    listed = [_plain_runs(t) for texts in NOTICES.values() for t in texts]
    chosen: list[str] = []
    while True:
        short = [r for r in listed if len([x for x in r if not set(x) & set(chosen)]) >= similar * len(r)]
        if not short:
            return chosen
        counts = Counter(w for r in short for w in {w for x in r for w in x} if w not in chosen)
        chosen.append(max(counts, key=lambda w: (min(len(w), 7), counts[w], w)))


def kin() -> list[str]:
    """Pairs of numbers of notices that share half of the word runs of one of them, as strings."""
    listed = [_plain_runs(t) for _, texts in sorted(NOTICES.items()) for t in texts]
    return [f"{i} {j}" for i, a in enumerate(listed) for j, b in enumerate(listed) if 2 * len(a & b) >= min(len(a), len(b))]


@dataclass
class LicenceModel:
    """weights: run, and a weight per family; what a paragraph without runs gets; the least probability of a finding."""

    families: list[str]
    weights: DataFrame
    intercepts: list[float]
    threshold: float


def _shares(hits: DataFrame, keys: list[str], spark: SparkSession) -> DataFrame:
    """keys, family, share, notice: the largest share of a notice's runs that some lines have, from their runs."""
    known = notice_runs(spark)
    shares = (hits.join(F.broadcast(known), "run").groupBy(*keys, "notice", "family")
              .agg((F.count(F.lit(1)) / F.first("runs")).alias("share")))
    best = F.max(F.struct("share", (-F.col("notice")).alias("notice")))
    return shares.groupBy(*keys, "family").agg(best.alias("best")).select(*keys, "family", "best.share", (-F.col("best.notice")).alias("notice"))


def _examples(spark: SparkSession) -> DataFrame:
    """family, runs: notices whole and cut short at either end."""
    words = F.split("paragraph", " ")
    cut = notices(spark).withColumn("words", words).withColumn("front", F.explode(F.sequence(F.lit(0), F.lit(3))))
    cut = cut.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(6), F.lit(2))))
    length = F.size("words") - F.col("front") - F.col("back")
    cut = cut.filter(length >= 4).withColumn("part", F.array_join(F.slice("words", F.col("front") + 1, length), " "))
    return cut.select("family", word_runs(F.col("part")).alias("all"))


def _known_runs(line: Column, vocabulary: list[str]) -> Column:
    """Those of a line's ``word_runs`` that are in ``vocabulary``, sorted; it holds the pairs within each of its runs of three."""
    pairs, threes = [v for v in vocabulary if v.count(" ") == 1], [v for v in vocabulary if v.count(" ") == 2]
    starts, ends = sorted({v.split(" ")[0] for v in pairs}), sorted({v.split(" ")[1] for v in pairs})
    among = lambda listed: F.when(listed[1].isin(listed[0]), listed[1])

    def joined(w: Column) -> Column:
        return F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))),
                          lambda a, b: F.when(a.isin(starts) & b.isin(ends), F.concat_ws(" ", a, b)))

    def both(w: Column, two: Column) -> Column:
        three = F.transform(two, lambda x, i: F.when(F.get(two, i + 1).isNotNull(), F.concat_ws(" ", x, F.get(w, i + 2))))
        return F.array_sort(F.array_distinct(F.array_compact(F.concat(two, F.transform(three, lambda x: among((threes, x)))))))

    def runs(w: Column) -> Column:
        return F.transform(F.array(F.transform(joined(w), lambda x: among((pairs, x)))), lambda two: both(w, two))[0]

    # the words are taken apart once
    return F.transform(F.array(_words(line)), runs)[0]


def _vocabulary(spark: SparkSession) -> list[str]:
    # as many runs as the notices have
    return sorted(r["run"] for r in notice_runs(spark).select("run").distinct().collect())


def _ordinary(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """The distinct lines of the corpus that are no notices: all (their runs that are in notices), apart (kept for the calibration)."""
    some = lines(docs).filter(F.col("paragraph") != "")
    some = some.select(F.xxhash64("paragraph").alias("place"), _known_runs(F.col("paragraph"), _vocabulary(spark)).alias("all")).distinct()
    some = durable(some)
    # lines with the same runs are as near
    alike = durable(some.filter(F.size("all") > 0).select("all").distinct())
    near = _shares(alike.select("all", F.explode("all").alias("run")), ["all"], spark).filter(F.col("share") >= SIMILAR / 2)
    # most lines have no runs or the same few: each set of them is spread over the tasks
    near = near.select("all").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    spread = some.withColumn("salt", F.pmod(F.shiftright("place", 8), F.lit(SALTS)))
    return spread.join(near, ["all", "salt"], "left_anti").select("all", (F.pmod("place", F.lit(APART)) == 0).alias("apart"))


def train(docs: DataFrame) -> LicenceModel:
    """Weights from the notices and all distinct lines of the corpus; lines with the same runs are one row that counts as many."""
    spark = docs.sparkSession
    families = [UNKNOWN, *sorted(NOTICES)]
    vocabulary = _vocabulary(spark)
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    ordinary = durable(_ordinary(docs, spark).groupBy("all", "apart").agg(F.count(F.lit(1)).alias("n")))
    once = F.lit(1).cast("long").alias("n")
    rows = (_examples(spark).select("all", number.alias("label"), once)
            .unionByName(ordinary.filter(~F.col("apart")).select("all", F.lit(0.0).alias("label"), "n"))
            .unionByName(notices(spark).limit(1).select(F.array().cast("array<string>").alias("all"), F.lit(0.0).alias("label"), once)))
    vector = CountVectorizerModel.from_vocabulary(vocabulary, "all", "features")
    vector.setBinary(True)
    rows = durable(vector.transform(rows).select("features", "label", "n"))
    sizes = rows.groupBy("label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    tasks = 1 + sum(r["rows"] for r in sizes.collect()) // TASK_ROWS
    rows = rows.join(F.broadcast(sizes.drop("rows")), "label").select("features", "label", (F.col("n") / F.col("total")).alias("weight"))
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.002, elasticNetParam=1.0, standardization=False,
                                maxIter=60, tol=1e-4).fit(durable(rows.coalesce(tasks)))
    matrix = fitted.coefficientMatrix.toArray()
    weights = [(run, [float(v) for v in matrix[:, j]]) for j, run in enumerate(vocabulary) if abs(matrix[:, j]).max() > 0]
    model = LicenceModel(families, spark.createDataFrame(weights, "run string, weights array<double>"),
                         [float(v) for v in fitted.interceptVector], LEAST_PROBABILITY)
    apart = ordinary.filter("apart").select("n", F.monotonically_increasing_id().alias("row"), F.explode("all").alias("run"))
    best = _best(apart, ["row", "n"], model).groupBy("probability").agg(F.sum("n").alias("n"))
    model.threshold = max(LEAST_PROBABILITY, best.agg(F.percentile("probability", 1 - FALSE_SHARE, F.col("n"))).first()[0] or 0.0)
    return model


def _best(hits: DataFrame, keys: list[str], model: LicenceModel) -> DataFrame:
    """keys, family, probability: the likeliest known family of each paragraph, from its runs."""
    found = hits.join(F.broadcast(model.weights), "run")
    sums = found.groupBy(*keys).agg(*[F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(len(model.families))])
    scores = [F.exp(F.col(f"s{i}") + F.lit(b)) for i, b in enumerate(model.intercepts)]
    total = sum(scores[1:], scores[0])
    # the largest probability, and of equal ones the first name
    ranked = F.array_sort(F.array(*[F.struct((-s / total).alias("p"), F.lit(f).alias("f")) for s, f in zip(scores[1:], model.families[1:])]))
    return sums.select(*keys, ranked[0]["f"].alias("family"), (-ranked[0]["p"]).alias("probability"))


def _line_runs(hits: DataFrame) -> DataFrame:
    """row, first, start, stop, run: the distinct runs of each run of lines that may hold a notice."""
    block = ["row", "first"]
    begins = hits.groupBy(*block, "start").agg(F.max("at").alias("low"))
    ends = hits.groupBy(*block, "stop").agg(F.min("at").alias("high"))
    # the run that ends may begin a word before the last one that begins a line earlier
    cell = F.floor(F.col("low") / SPAN)
    near = begins.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    several = (near.join(ends.withColumn("cell", F.floor((F.col("high") + 1) / SPAN)), [*block, "cell"])
               .filter((F.col("start") < F.col("stop")) & (F.col("high") - F.col("low") < SPAN - 1)))
    single = hits.filter("start = stop").select(*block, "start", "stop").distinct()
    spans = several.select(*block, "start", "stop").unionByName(single)
    spans = spans.withColumn("line", F.explode(F.sequence("start", "stop"))).withColumnsRenamed({"start": "from", "stop": "to"})
    inside = hits.withColumn("line", F.col("start")).join(spans, [*block, "line"]).filter(F.col("stop") <= F.col("to"))
    return inside.select(*block, F.col("from").alias("start"), F.col("to").alias("stop"), "run").distinct()


def _apart(found: DataFrame) -> DataFrame:
    """Of ``found`` with overlapping lines and kin notices the one of the largest share, then the shortest, then the first."""
    place = F.struct((-F.col("share")).alias("less"), (F.col("stop") - F.col("start")).alias("more"), "start", "stop", "family", "probability", "notice")
    listed = found.groupBy("doc_id", "row", "first").agg(F.array_sort(F.collect_list(place)).alias("all"))
    alike = F.array(*map(F.lit, kin()))

    def take(chosen: Column, x: Column) -> Column:
        met = F.exists(chosen, lambda c: (c["start"] <= x["stop"]) & (x["start"] <= c["stop"])
                       & F.array_contains(alike, F.concat_ws(" ", c["notice"].cast("string"), x["notice"].cast("string"))))
        return F.when(met, chosen).otherwise(F.concat(chosen, F.array(x)))

    return listed.select("doc_id", F.explode(F.aggregate("all", F.slice("all", 1, 0), take)).alias("x"))


def license_paragraphs(docs: DataFrame, model: LicenceModel, similar: float = SIMILAR, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, line (the first), family, probability, similarity of each run of lines that is a notice."""
    spark = docs.sparkSession
    words = key_words(similar)

    def may(text: Column) -> Column:
        # the text is folded once
        return F.exists(F.array(F.lower(text)), lambda low: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))

    runs = placed_runs(paragraphs(docs.filter(may(F.col(text_col))), may, id_col, text_col))
    # few runs of a corpus occur in notices
    placed = durable(runs.join(F.broadcast(notice_runs(spark).select("run").distinct()), "run"))
    keys = ["row", "first", "start", "stop"]
    hits = durable(_line_runs(placed))
    best = _best(hits, keys, model).filter(F.col("probability") > model.threshold)
    near = _shares(hits, keys, spark).filter(F.col("share") >= similar)
    names = placed.select("doc_id", "row", "first").distinct()
    found = best.join(near, [*keys, "family"]).join(names, ["row", "first"])
    return _apart(found).select("doc_id", F.col("x.start").cast("long").alias("line"), "x.family", "x.probability", (-F.col("x.less")).alias("similarity"))


@query("op4_license_scan")
def op4(spark, folder):
    docs = table(spark, folder, "documents")
    return license_paragraphs(docs, train(docs))
