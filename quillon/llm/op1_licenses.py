"""Licence scan: a trained paragraph classifier over sparse word n-grams, with DataFrame functions only.

A multinomial logistic regression with elastic-net penalty (Spark's own, on the JVM) learns licence families from notices, names in usual
phrases, and a bounded sample of paragraphs as the unknown class. Its probabilities are calibrated by a temperature on phrases and
notices that it is not trained on. Scoring is relational: n-grams of the paragraphs that hold any evidence (a word or a pair of words)
are joined with the table of weights and summed. A paragraph is a line, and also a block of lines, for notices that are wrapped. A
family counts only if its templates confirm it: one of its names stands in the paragraph, or enough trigrams of one of its notices.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table

#: Bound of the sample of paragraphs for the unknown class, and of the model's vocabulary.
SAMPLE_PARAGRAPHS, VOCABULARY = 2_000, 6_000
MIN_PROBABILITY, MIN_SHARED = 0.5, 0.5
UNKNOWN = "unknown"

#: Names and typical sentences of public licences.
NAMES = {
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache Software License", "Apache-2.0"],
    "mit": ["MIT License", "MIT license terms", "Expat License", "MIT"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL v3", "GPL-3.0 license", "GPL version 2 or later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "GPL", "GPLv2", "GPLv3"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL-3.0 license", "LGPL version 2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL", "LGPLv3"],
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0 license", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPL", "AGPLv3"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0 license", "MPL-2.0", "MPL"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC-BY-4.0", "CC BY"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC-BY-SA-4.0", "CC BY-SA"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0", "CC BY-NC"],
    "cc0": ["CC0 1.0 Universal", "Creative Commons Zero public domain dedication", "CC0 public domain dedication", "CC0-1.0"],
    "isc": ["ISC License", "ISC license terms", "ISC"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License, version 1.0", "EPL-2.0"],
    "unlicense": ["The Unlicense", "Unlicense license terms", "Unlicense"],
    "boost": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"],
    "proprietary": ["proprietary license, all rights reserved", "commercial license of its owner, all rights reserved"],
}
NOTICES = {
    "apache": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version", "You should have received a copy of the GNU General Public License along with this program"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0"],
    "cc-by": ["You are free to share and adapt the material for any purpose, even commercially, if you give appropriate credit under the Creative Commons Attribution license"],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original, Creative Commons Attribution-ShareAlike"],
    "cc-by-nc": ["You may not use the material for commercial purposes under the Creative Commons Attribution-NonCommercial license"],
    "cc0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under CC0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at eclipse.org/legal/epl-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced or transmitted without prior written permission of the publisher", "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited"],
}
PHRASES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This project is made available under {}.", "The code is published under the {}, see LICENSE for details.", "SPDX-License-Identifier: {}", "Distributed under {} terms.", "License: {}", "Code is {} licensed.", "Licence: {}"]
#: Phrases and beginnings of notices that calibrate the probabilities and are not trained on.
TRIAL_PHRASES = ["Covered by the {}.", "You may use these files under the terms of {}.", "Dual licensed; see also {}.", "It was put under {} by its authors in 2019.", "License identifier {} applies"]
TRIAL_WORDS = slice(3, 18)
#: Words that always make a paragraph worth a look.
CUES = ("license", "licence", "licensed", "licenced", "copyright")
#: Sentences that use the same words for something else, or name no known licence.
OTHERS = ["Licensed under the Acme Corporate Agreement.", "Released under the bridge.", "Released under a new title.", "This work is licensed under terms to be agreed.", "His driving license was issued in the state.", "The license plate was red.", "Distributed under the tables of the hall.", "Permission is needed to enter the building.", "She attended MIT and studied physics.", "The Apache people lived in the plains.", "A copy of this letter was made available to the public.", "The general public was invited.", "The copyright office opened in May.", "Version 3 of the report was published.", "Creative work is common in schools.", "Free software is made by people.", "The project is made available under certain conditions, see the manual for details."]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct words and word pairs."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda p: p.isNotNull())))


def trigrams(words: Column) -> Column:
    two = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(two, F.slice(words, F.lit(3), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(three, lambda p: p.isNotNull()))


def examples() -> list[tuple[str, str]]:
    rows = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in PHRASES]
    for f, notices in NOTICES.items():
        for t in notices:
            w = t.split()
            rows += [(f, " ".join(x)) for x in (w, w, w, w[:12], w[:20], w[-12:]) if len(x) > 5]
            rows += [(f, x) for x in t.split(". ") if len(x.split()) > 2]
    return rows + [(UNKNOWN, t) for t in OTHERS for _ in range(3)]


def trials() -> list[tuple[str, str]]:
    rows = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in TRIAL_PHRASES]
    return rows + [(f, " ".join(t.split()[TRIAL_WORDS])) for f, notices in NOTICES.items() for t in notices]


def paragraphs(docs: DataFrame, doc_id: str, text: str, only: Column | None = None) -> DataFrame:
    """doc_id, of (hash of the text), level (line, or block of several lines), place, paragraph."""
    d = docs.filter(F.col(text).isNotNull())
    d = d if only is None else d.filter(only)
    d = d.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("of"), F.col(text).alias("said"))
    lines = F.transform(F.split("said", r"[\n\r]+"), lambda x, i: F.struct(F.lit("line").alias("level"), i.alias("place"), x.alias("paragraph")))
    blocks = F.filter(F.transform(F.split("said", r"(?:\r?\n[ \t]*){2,}"), lambda x, i: F.struct(F.lit("block").alias("level"), i.alias("place"), x.alias("paragraph"))), lambda x: F.trim(x["paragraph"]).contains("\n"))
    return d.select("doc_id", "of", F.explode(F.concat(lines, blocks)).alias("p")).select("doc_id", "of", "p.*").filter(F.trim("paragraph") != "")


#: What stands between the names of several licences in one line.
JOINTS = r"(?i)\s+(?:and|or|und|oder|et|ou)(?:\s+(?:the|at your option|alternatively))?\s+|\s*[;/|&+]\s*|\)\s*\("


def clauses(held: DataFrame) -> DataFrame:
    """The paragraphs, and the parts of every line that names a licence between joints, each behind the word that makes it one.

    A part has the line's place, its own number (nth, 0 for the line) and the level clause.
    """
    own = F.struct("level", "paragraph", "words", "cue")
    part = lambda x: F.concat(F.lit("License: "), x)
    parts = F.transform(F.split("paragraph", JOINTS), lambda x: F.struct(F.lit("clause").alias("level"), part(x).alias("paragraph"), tokens(part(x)).alias("words"), F.lit(True).alias("cue")))
    split = (F.col("level") == "line") & F.col("cue") & F.col("paragraph").rlike(JOINTS)
    return held.select("doc_id", "of", "place", F.posexplode(F.when(split, F.concat(F.array(own), parts)).otherwise(F.array(own))).alias("nth", "a")).select("doc_id", "of", "place", "nth", "a.*")


@dataclass
class Model:
    classes: list[str]
    intercepts: list[float]
    #: n-gram -> weight of every class; only n-grams with some weight.
    weights: dict[str, list[float]]
    temperature: float
    #: Words, and pairs of words, of which a paragraph needs one at least to be looked at.
    evidence: list[str]
    pairs: list[str]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on the examples and at most SAMPLE_PARAGRAPHS paragraphs without licence words, sampled by hash."""
    spark = docs.sparkSession
    cue = r"(?i)licen[cs]|copyright|\bgpl|creative commons|rights reserved|\bcc[ -]?(by|0)"
    n = docs.count()
    near = docs.filter(F.pmod(F.xxhash64(F.lit(1), doc_id), F.lit(1_000_000)) * (n / 1_000_000) <= SAMPLE_PARAGRAPHS / 4)
    sample = paragraphs(near, doc_id, text).filter(~F.col("paragraph").rlike(cue) & (F.col("level") == "line")).select("paragraph")
    sample = sample.orderBy(F.xxhash64("paragraph"), "paragraph").limit(SAMPLE_PARAGRAPHS).withColumn("family", F.lit(UNKNOWN))
    given = spark.createDataFrame(examples(), "family string, paragraph string")
    rows = materialize(given.unionByName(sample).withColumn("grams", grams(tokens(F.col("paragraph")))).coalesce(1), "licence-examples")
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, binary=True).fit(rows.filter(F.col("family") != UNKNOWN).unionByName(rows.filter(F.col("paragraph").isin(OTHERS))))
    classes = [UNKNOWN, *NAMES]
    label = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    data = vocabulary.transform(rows.withColumn("label", label)).select("features", "label")
    fit = LogisticRegression(family="multinomial", regParam=0.00002, elasticNetParam=0.5, maxIter=60).fit
    model = fit(data)
    tried = spark.createDataFrame(trials(), "family string, paragraph string").withColumn("grams", grams(tokens(F.col("paragraph")))).withColumn("label", label)
    judged = model.transform(vocabulary.transform(tried)).select("rawPrediction", "label").collect()
    temperature = min((t / 10 for t in range(3, 61)), key=lambda t: sum(math.log(sum(math.exp((x - r["rawPrediction"][int(r["label"])]) / t) for x in r["rawPrediction"])) for r in judged))
    w = model.coefficientMatrix.toArray()
    weights = {g: [float(x) for x in w[:, k]] for k, g in enumerate(vocabulary.vocabulary) if w[:, k].any()}
    plain = {r["g"] for r in rows.filter((F.col("family") == UNKNOWN) & ~F.col("paragraph").isin(OTHERS)).select(F.explode("grams").alias("g")).distinct().join(F.broadcast(spark.createDataFrame([(g,) for g in weights], "g string")), "g").collect()}
    telling = sorted(g for g, x in weights.items() if max(x[1:]) > 0 and g not in plain)
    return Model(classes, [float(x) for x in model.interceptVector], weights, temperature, sorted({*CUES, *(g for g in telling if " " not in g)}), [g for g in telling if " " in g])


def _confirmed(words: Column, guess: Column) -> Column:
    """1 if one of the family's names stands in the paragraph, else the largest share of a notice's trigrams that are shared, either way."""
    plain = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    # A name of one word counts only beside a word that makes it one, unless it holds a version.
    beside = ("identifier {}", "{} license", "{} licence", "{} licensed", "{} licenced", "{} terms", "license {}", "licence {}", "license the {}", "licence the {}", "under {}", "under the {}", "terms of the {}")
    forms = lambda x: [x] if " " in x or x[-1].isdigit() else [b.format(x) for b in beside]
    names = {f: sorted({n for x in own for n in forms(plain(x))}) for f, own in NAMES.items()}
    names["proprietary"].append("all rights reserved")
    by_name = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(n) for n in x]) for f, own in names.items() for x in (f, own)])
    said = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    named = F.exists(F.element_at(by_name, guess), lambda n: said.contains(F.concat(F.lit(" "), n, F.lit(" "))))
    notices = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.array(*[F.lit(w) for w in plain(t).split()]) for t in x]) for f, own in NOTICES.items() for x in (f, own)])
    mine = trigrams(words)
    share = F.array_max(F.transform(F.element_at(notices, guess), lambda t: F.size(F.array_intersect(mine, trigrams(t))) / F.greatest(F.least(F.size(mine), F.size(trigrams(t))), F.lit(1))))
    return F.when(F.coalesce(named, F.lit(False)), 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs that hold evidence: doc_id, of (hash of the text), level, place, paragraph, family, probability, shared, confirmed.

    Lines with an evidence word, or with a family more likely than not, have a row: unknown unless confirmed. Parts of a line that name
    other licences (level clause) have a row each for a family that no line confirms, and stand for the line if it is unknown. A block of
    lines has one only if it confirms a family that none of the document's lines and their parts does. A reservation of rights is proprietary only where the
    document names no licence. A paragraph without evidence, a null or empty text and an empty table give no rows. Repeated rows give
    their paragraphs once; null ids are kept; other columns are ignored. Equal probabilities go to the class named first.
    """
    spark = docs.sparkSession
    listed = lambda x: F.array(*[F.lit(w) for w in x or ["\0"]])
    all_words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    two = lambda w: F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    some = F.arrays_overlap(all_words, listed(model.evidence)) | F.arrays_overlap(two(all_words), listed(model.pairs))
    cue = F.arrays_overlap("words", listed(model.evidence))
    held = paragraphs(docs, doc_id, text, some).withColumn("words", tokens(F.col("paragraph"))).withColumn("cue", cue).filter(F.col("cue") | F.arrays_overlap(two(F.col("words")), listed(model.pairs))).dropDuplicates(["doc_id", "of", "level", "place"])
    # Paragraphs are written once; only their n-grams' weights, summed where they are read, travel.
    held = materialize(clauses(held).withColumn("pid", F.monotonically_increasing_id()), "licence-paragraphs")
    weights = F.broadcast(spark.createDataFrame([(g, w) for g, w in model.weights.items()], "g string, w array<double>"))  # at most VOCABULARY rows
    k = len(model.classes)
    parts = held.select("pid", F.explode(grams(F.col("words"))).alias("g")).join(weights, "g").groupBy("pid").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"z{i}") for i in range(k)])
    sums = held.join(parts, "pid", "left").select(*held.columns, F.array(*[F.coalesce(f"z{i}", F.lit(0.0)) + model.intercepts[i] for i in range(k)]).alias("z"))
    sums = sums.withColumn("z", F.transform("z", lambda x: x / model.temperature)).withColumn("top", F.array_max("z"))
    sums = sums.withColumn("best", F.array_position("z", F.col("top")).cast("int")).withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    family = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.col("best"))
    sums = sums.select("doc_id", "of", "level", "place", "paragraph", "words", "cue", family.alias("guess"), "probability").withColumn("shared", _confirmed(F.col("words"), F.col("guess")))
    sure = (F.col("guess") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY) & (F.col("shared") >= MIN_SHARED)
    mine, line = W.partitionBy("doc_id", "of"), W.partitionBy("doc_id", "of", "place")
    of_level = lambda *levels: F.collect_set(F.when(F.col("sure") & F.col("level").isin(*levels), F.col("guess")))
    sums = sums.withColumn("sure", sure).withColumns({"in_lines": of_level("line").over(mine), "in_parts": of_level("line", "clause").over(mine), "in_all": of_level("line", "clause", "block").over(mine), "told": F.size(of_level("clause").over(line)) > 0})
    likely = (F.col("guess") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY)
    new = lambda known: F.col("sure") & ~F.array_contains(known, F.col("guess"))
    of_line = F.col("sure") | ((F.col("cue") | likely) & ~F.col("told"))
    sums = sums.filter(F.when(F.col("level") == "line", of_line).when(F.col("level") == "clause", new("in_lines")).otherwise(new("in_parts")))
    sure = F.col("sure") & ((F.col("guess") != "proprietary") | (F.size(F.array_remove("in_all", "proprietary")) == 0))
    return sums.filter((F.col("level") == "line") | sure).select("doc_id", "of", "level", "place", "paragraph", F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "shared", sure.alias("confirmed"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, families (sorted), n_licence_paragraphs, n_unknown (held evidence, but none confirmed)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs)).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.count_if("confirmed").alias("n_licence_paragraphs"),
        F.count_if(~F.col("confirmed")).alias("n_unknown"),
    )
    left = docs.select("doc_id")
    return left.join(found, left["doc_id"].eqNullSafe(found["doc_id"]), "left").select(
        left["doc_id"], F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_licence_paragraphs", F.lit(0)).alias("n_licence_paragraphs"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown")
    )
