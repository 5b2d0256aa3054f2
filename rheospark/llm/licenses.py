"""License scans: a trained paragraph classifier, confirmed by comparison with templates. DataFrame and ML functions only.

A paragraph is a window of up to WINDOW words between blank lines, whatever the lines, so that a notice may be wrapped or
stand in a very long line; the next window begins half a window later, and no template is longer than that. Only windows
with one of the ANCHORS are looked at, which loses nothing: more than 1 - CONFIRMED of each template's word pairs hold an
anchor, so a window without any confirms no template. Features of a window are its words and word pairs, hashed and
sparse. A multinomial logistic regression knows the licence families of TEMPLATES and the class "none". It is fitted on
the templates, alone and among lines of the corpus, and on a bounded sample of lines that are like no template and don't
speak of licensing (TERMS).

Its probabilities are calibrated over all windows: in each of BINS classes of the top probability, the share of windows
that a template confirms, of those that one confirms or that are like none, is what the probability is worth. What is
worth less than LEAST is unknown. A prediction stands if enough word pairs of one of the family's templates are in the
window; templates of SENTENCES must end a sentence or line there too. A window with one of TERMS that the classifier
doesn't hold for none (SOME), and of which no family stands, is a licence of an unknown family.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, least_hashes, table, written

#: Passages that give notice of a licence, or its terms, by family.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
    ],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file is strictly prohibited."],
}
#: Lines of "none" that share words with licences.
OTHERS = [
    "The driver's license was renewed by the general office.",
    "Public transport is free of charge to any person in version 2.0 of the plan.",
    "You may obtain a copy of the book at the library.",
    "Women's rights and all reserved seats were discussed in general terms.",
    "The copyright office gave notice that the conditions of distribution had changed.",
    "A software licence fee is due for every copy that the company sells under the contract.",
]
#: Beginnings of words of which each template has enough. A test counts.
ANCHORS = "licen,copyright,permission,permit,warrant,redistribut,gnu,mozilla,mpl,public domain,reserved,unauthorized,prohibited,software,distributed,cc by,cc-by,cc0,eclipse,conditions,apache,compliance,notice,merchantab,free of charge,granted,modif,copies,sublicen,express,implied,provided,bsd,governed,reproduce,subject to,source code,accompanying,creative commons,attribution,dedicated,unencumbered,waived,released,copying,extent".split(",")
#: Words of a window; twice the longest template's at least. A test counts.
WINDOW = 160
#: Templates that say something else inside a sentence, and what follows them as a notice.
SENTENCES, SENTENCE_END = ["All rights reserved."], r"\s*(?:[.!;)*]|\n|$)"
#: Fixed value: what a notice of a licence that no template knows says.
TERMS = r"(?i)\b(?:licensed? under|under the (?:terms of the )?[\w .-]{1,60}licen[cs]e|licen[cs]e:|licen[cs]e,? version|-clause licen[cs]e|permission is (?:hereby )?granted|redistribution and use)"
#: Lines of the corpus that the classifier is fitted on, at most; lines that templates stand between.
SAMPLE, FILLERS = 4000, 12
#: Hashed features; classes of probability; what a probability is worth at least.
FEATURES, BINS, LEAST = 1 << 13, 20, 0.5
#: Probability of all families together from which a window with one of TERMS is a licence of some family.
SOME = 0.25
#: Share of a template's word pairs that confirms a family, and that bars a window from being like none.
CONFIRMED, LIKE = 0.7, 0.3
NONE, UNKNOWN = "none", "unknown"


def _words(text: Column) -> Column:
    """Lower-case runs of letters, digits and inner dots, pluses, hyphens and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.+'-][\p{L}\p{N}]+)*"), F.lit(0))


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _template_pairs(spark: SparkSession) -> dict[str, list[list[str]]]:
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    made = spark.createDataFrame(rows, "family string, text string").select("family", F.array_distinct(_pairs(_words(F.col("text")))).alias("p")).collect()
    return {family: [r.p for r in made if r.family == family] for family in TEMPLATES}


def _similarity(pairs: Column, templates: list[list[str]], sentences: Column | None = None) -> Column:
    """The greatest share of a template's word pairs that stand in the paragraph. sentences: whether one of SENTENCES stands as
    such; else these count as not there."""
    alone = [" ".join(t.lower().rstrip(".").split()) for t in SENTENCES]

    def share(t: list[str]) -> Column:
        found = F.size(F.array_intersect(pairs, F.array(*map(F.lit, t)))) / len(t)
        whole = " ".join([t[0], *(p.split(" ")[-1] for p in t[1:])])
        return F.when(sentences, found).otherwise(0.0) if sentences is not None and whole in alone else found

    shares = [share(t) for t in templates]
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def _stands_alone(line: Column) -> Column:
    return line.rlike("(?i)(?:" + "|".join(r"\s+".join(t.rstrip(".").split()) for t in SENTENCES) + ")" + SENTENCE_END)


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_k, block, paragraph (a number in the block), line (the window's text), for windows with an anchor."""
    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)
    hit = r"(?i)\b(?:" + "|".join(ANCHORS) + ")"
    # a blank line ends a block; blocks are cut into windows that begin half a window apart
    rows = docs.where(F.col(f"`{text}`").rlike(hit)).select(F.col(f"`{key}`").alias("_k"), lines.alias("l"))
    blocks = F.filter(F.split(F.array_join(F.transform("l", lambda x: F.when(x.rlike(WORD), x).otherwise(F.lit(""))), "\n"), "\n\n+", -1), lambda b: b.rlike(hit))
    rows = rows.select("_k", F.posexplode(blocks).alias("block", "b"))
    words = F.regexp_extract_all("b", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*\n?"), F.lit(0))  # a line's end stays with its word
    rows = rows.select("_k", "block", words.alias("w"))
    half = WINDOW // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - half - 1, F.lit(0)), F.lit(half))
    windows = F.transform(starts, lambda i: F.regexp_replace(F.array_join(F.slice("w", i + 1, WINDOW), ""), r"[\x20\x09\x0B-\x0D]+", " "))
    return rows.select("_k", "block", F.posexplode(windows).alias("paragraph", "line")).where(F.col("line").rlike(hit))


def _featured(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("w", _words(F.col("line")))
    rows = rows.withColumns({"p": _pairs(F.col("w")), "terms": F.concat("w", _pairs(F.col("w")))})
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True).transform(rows).drop("terms")


def fit(docs: DataFrame, key: str, text: str) -> tuple[LogisticRegressionModel, dict[str, list[list[str]]]]:
    """The model, fitted on the templates and at most SAMPLE lines of the corpus, and the templates' word pairs."""
    spark = docs.sparkSession
    templates = _template_pairs(spark)
    families = list(TEMPLATES)
    lines = docs.select(F.explode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("line")).where(F.col("line").rlike(WORD))
    picked = least_hashes(lines.select("line", F.xxhash64("line").alias("h")), lines.count(), SAMPLE, "h", "line")
    none = _featured(picked.select("line", "h"))
    like = _similarity(F.col("p"), [t for ts in templates.values() for t in ts])
    none = none.where((like < LIKE) & ~F.col("line").rlike(TERMS)).select("line", "h", F.lit(float(len(families))).alias("label"))
    none = written(none, "none")
    fillers = [r.line[:400] for r in none.orderBy("h").limit(FILLERS).collect()] or ["Some other words."]
    rows = []
    for label, family in enumerate(families):
        for notice in TEMPLATES[family]:
            rows.append((notice, float(label)))
            rows += [(x, float(label)) for f in fillers for x in (f"{f} {notice}", f"{notice} {f}", f"{f} {notice} {f}")]
    rows += [(x, float(len(families))) for x in OTHERS for _ in range(10)]
    positive = spark.createDataFrame(rows, "line string, label double")
    training = written(positive.unionByName(none.drop("h")).repartition(2), "training")
    model = LogisticRegression(maxIter=40, regParam=1e-3, family="multinomial", standardization=False).fit(_featured(training))
    return model, templates


def _worth(scored: DataFrame) -> DataFrame:
    """bin, worth: at most BINS rows. Worth never falls with the probability: a class has at least what lies below it."""
    sure, unlike = F.count_if(F.col("similarity") >= CONFIRMED), F.count_if(F.col("like") < LIKE)
    by_bin = scored.groupBy("bin").agg((sure / F.nullif(sure + unlike, F.lit(0))).alias("share"))
    return by_bin.select("bin", F.max(F.coalesce("share", F.lit(0.0))).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("worth"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row of docs: key, n_paragraphs (windows with an anchor), n_licences (families in each block, confirmed),
    family (of the most probable; without one "unknown" if a window is a licence of no known family, else "none"),
    families (all, comma-separated in order of name), probability (as calibrated), similarity, n_unknown (blocks with
    such a window and no confirmed family).

    Null, empty and blank texts: no paragraphs, "none", nulls. Rows that share a key are one document, a null key too.
    Empty table: empty result. Other columns of docs aren't read, whatever their names.
    """
    docs = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    model, templates = fit(docs, key, text)
    families = list(TEMPLATES)
    scored = model.transform(_featured(paragraphs(docs, key, text))).withColumn("probs", F.slice(vector_to_array("probability"), 1, len(families)))
    licence = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    scored = scored.withColumns({"alone": _stands_alone(F.col("line")), "licence": (licence >= SOME) & F.col("line").rlike(TERMS)})
    scored = scored.select("_k", "block", "p", "alone", "licence", F.array_max("probs").alias("top"), F.array_position("probs", F.array_max("probs")).cast("int").alias("at"))
    scored = scored.withColumn("family", F.element_at(F.array(*map(F.lit, families)), F.col("at")))
    similarity = F.coalesce(*[F.when(F.col("family") == f, _similarity(F.col("p"), templates[f], F.col("alone"))) for f in families])
    like = _similarity(F.col("p"), [t for ts in templates.values() for t in ts])
    bin_of = F.least(F.floor(F.col("top") * BINS), F.lit(BINS - 1)).cast("int")
    scored = written(scored.select("_k", "block", "licence", "family", "top", bin_of.alias("bin"), similarity.alias("similarity"), like.alias("like")), "scored")
    confirmed = scored.join(F.broadcast(_worth(scored)), "bin").where((F.col("worth") >= LEAST) & (F.col("similarity") >= CONFIRMED))
    # a licence in two windows of a block is one; a document's windows meet here as one row for each block and family
    blocks = confirmed.groupBy("_k", "block", "family").agg(F.max(F.struct("worth", "top", "similarity")).alias("m"))
    by_doc = blocks.groupBy("_k").agg(
        F.count("*").alias("n_licences"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max(F.struct("m.worth", "m.top", "m.similarity", "family")).alias("best"),
    )
    other = scored.where("licence").select("_k", "block").distinct().join(blocks.select(F.col("_k").alias("_b"), F.col("block").alias("_o")), F.col("_k").eqNullSafe(F.col("_b")) & (F.col("block") == F.col("_o")), "left_anti")
    other = other.groupBy(F.col("_k").alias("_u")).agg(F.count("*").alias("n_unknown"))
    n_windows = scored.groupBy(F.col("_k").alias("_w")).agg(F.count("*").alias("n"))
    every = docs.select(F.col(f"`{key}`").alias("_k")).distinct()
    out = every.join(n_windows, F.col("_k").eqNullSafe(F.col("_w")), "left").join(by_doc.withColumnRenamed("_k", "_d"), F.col("_k").eqNullSafe(F.col("_d")), "left")
    out = out.join(other, F.col("_k").eqNullSafe(F.col("_u")), "left")
    return out.select(
        F.col("_k").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("best.family", F.when(F.col("n_unknown") > 0, UNKNOWN).otherwise(NONE)).alias("family"), F.coalesce("families", F.lit("")).alias("families"),
        F.col("best.worth").alias("probability"), F.col("best.similarity").alias("similarity"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
