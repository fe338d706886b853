"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A sparse logistic regression over word n-grams gives each sentence that may speak of a licence the
probabilities of the licence families, of a licence of no known family, and of none. It learns from
templates in many settings, other licences' names, and a bounded sample of ordinary text; its temperature and its
threshold are calibrated on held-out sentences of the kind that is classified. Spark ML and built-in functions only.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Templates of each family, sentence by sentence: names, identifiers and notices as their licensors publish them. Fixed values.
TEMPLATES = {
    "agpl": (
        "GNU Affero General Public License", "AGPL", "AGPL 3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3", "AGPL licensed",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "apache": (
        "Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache licensed", "Apache 2.0 licensed",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "BSD License", "3-Clause BSD License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "BSD licensed",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "cc0": ("CC0", "CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "dedicated to the public domain under CC0", "has waived all copyright and related or neighboring rights to this work under CC0"),
    "cc-by": ("CC BY", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "Creative Commons Attribution 3.0 Unported License"),
    "cc-by-nc": ("CC BY-NC", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd": ("CC BY-NC-ND", "CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivs License"),
    "cc-by-nd": ("CC BY-ND", "CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs License"),
    "cc-by-sa": ("CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"),
    "gpl": (
        "GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL v3", "GPL v2", "GPLv3", "GPLv2", "GPL", "GPL licensed", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "GNU Lesser General Public License", "LGPL", "LGPL 2.1", "LGPL v3", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "LGPLv3", "LGPL licensed",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mit": (
        "MIT License", "the MIT Licence", "license: MIT", "MIT/X11", "SPDX-License-Identifier: MIT", "licensed under MIT", "MIT licensed",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "mpl": (
        "Mozilla Public License", "Mozilla Public License, version 2.0", "MPL", "MPL 2.0", "MPL-2.0", "MPLv2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "proprietary": ("All rights reserved", "No part of this publication may be reproduced, distributed or transmitted in any form or by any means, without the prior written permission of the publisher.", "may not be reproduced without prior written permission of the copyright holder", "proprietary and confidential"),
    "unlicense": (
        "The Unlicense", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: What narrows a Creative Commons licence; written as one word with the name that it follows, so that no shorter licence is confirmed by a part of it. Fixed values.
NARROWING = ("nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike")
#: Licences of none of these families. The first teach what an unknown licence is, the second calibrate.
OTHERS = (
    "Boost Software License 1.0", "zlib License", "Artistic License 2.0", "Common Development and Distribution License", "SIL Open Font License 1.1", "PostgreSQL License", "Python Software Foundation License", "Microsoft Public License", "Eclipse Public License 2.0",
    "ISC License", "Open Database License", "Q Public License 1.0", "Business Source License 1.1", "Sun Community Source License", "Custom Research License", "Vendor Terms of Use", "Example Corp Evaluation License 3.1", "Foo Public License",
    "BSL-1.0", "Zlib", "EPL-2.0", "OFL-1.1", "Artistic-2.0", "PSF-2.0", "Open Government Licence v3.0", "Community Data License Agreement", "Xyz 1.3 License", "ABCL 2.2 License", "Plain Text License 1.1", "Commons Clause License", "NASA Open Source Agreement",
)
OTHERS_HELD = ("European Union Public Licence 1.2", "EUPL-1.2", "Academic Free License 3.0", "Open Software License 3.0", "Elastic License 2.0", "Server Side Public License", "Licence Ouverte 2.0", "Bar Baz Terms 7", "Acme Internal License", "NTP License", "JSON License", "AFL-3.0", "University of Illinois Open Source License")
#: Sentences in which names of licences stand; the last ones calibrate.
CARRIERS = (
    "{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This project is available under the {}; see the file for details.",
    "SPDX-License-Identifier: {}", "The code is made available under the {}.", "Copyright (c) 2020 the authors. {}.", "{} applies to this document.", "License: {}", "See LICENSE for the full text of the {}.",
)
CARRIERS_HELD = ("This work is licensed under {}.", "All files here are covered by the {}, unless stated otherwise.", "You may use it under the {}")
#: Sentences that speak of licences or rights and name none; the last ones calibrate.
DECOYS = (
    "A driving licence is needed to rent a car.", "The licence was issued by the town last year.", "They reserved all the rooms on the right side.", "Copyright law is taught in the second term.", "The permission to build was given in spring.",
    "Released under a new name in the same year.", "The public license office is closed on Monday.", "Free of charge for any person under ten.", "The general public may see the garden.", "This work is done under the roof.", "He has the right to a copy of the report.",
    "The warranty of the car ended in May.", "She paid the license fee for the television.", "His fishing license has expired.", "The source code of the program was lost.", "Copyright is an old idea.", "The museum gave permission to take pictures.",
)
DECOYS_HELD = ("The pilot lost his licence after the flight.", "The copyright page of the book is missing.", "They asked for permission to enter the hall.", "A hunting licence costs ten coins.", "The warranty covers the roof.", "The free software meeting is on Friday.", "The shop has a licence to sell wine.", "Copyright disputes fill the courts.")
#: What speaks of a licence. Every template has one of these; sentences without one can still have most of a template's words (``anchors``).
CUE = r"(?i:licen[cs]e|copyright|rights reserved|permission|permitted|redistribut|public domain|creative commons|\bcc[ -]?(?:by|0)|gpl|\bmpl(?:v\d)?\b|\bbsd\b|spdx|warrant|source code|unencumbered|proprietary and|without limitation the rights|be reproduced|apache[ -]2|waived all)|\bMIT/X11"
#: A word with one of these in it gives any sentence a cue.
CUE_STEMS = ("license", "licence", "copyright", "permission", "permitted", "redistribut", "gpl", "spdx", "warrant", "unencumbered")
NONE, UNKNOWN = "none", "unknown"
#: Ordinary sentences to learn from: those of so many documents, and no more than so many sentences.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES = 500, 2_000
#: Words and pairs of words that the classifier knows at most.
VOCABULARY = 20_000
#: Share of a template's word pairs that a sentence must have to confirm a prediction.
CONFIRM = 0.8
#: Of held-out sentences with a cue that name no known family, at most this share may pass the threshold; it is no lower than LEAST.
FALSE_ALARMS, LEAST = 0.05, 0.3
#: A further family of the same sentence counts from this share of the best one's probability on.
FURTHER = 0.1
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits, and version numbers. ``by`` or ``attribution`` and the words of NARROWING that follow it, behind hyphens or single spaces, are one word."""
    plain = F.regexp_replace(F.lower(text), r"\b(non|no|share)-(commercial|derivatives|derivs|alike)\b", "$1$2")
    joined = F.regexp_replace(plain, rf"(?<=\b(?:by|attribution|{'|'.join(NARROWING)}))[- ](?=(?:{'|'.join(NARROWING)})\b)", "")
    return F.filter(F.transform(F.split(joined, r"[^\p{L}\p{N}.]+"), lambda x: F.btrim(x, F.lit("."))), lambda x: F.length(x) > 0)


def _pairs(words: Column) -> Column:
    """Each word but the last with the next one; a word alone makes a pair of its own."""
    follows = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(words, follows, lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit("")))), lambda x: ~x.endswith(" "))
    return F.when(F.size(words) == 1, words).otherwise(pairs)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(text: Column) -> Column:
    """The distinct words and pairs of neighbouring words of a text."""
    return _let(terms(text), lambda w: F.array_distinct(F.concat(w, _pairs(w))))


def paragraphs(text: Column) -> Column:
    """Blocks of lines: a blank line ends one, and so does a line that ends a sentence; wrapped lines stay together."""
    return F.filter(F.split(text, r"\r?\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\r\n"))) > 0)


def sentences(paragraph: Column) -> Column:
    return F.split(F.regexp_replace(paragraph, r"\s+[*#/]*\s*", " "), r"(?<=[.!?;])\s(?=[\p{Lu}\"(])")


@dataclass
class LicenceModel:
    """labels: families in order, then none and unknown. Probabilities are the softmax of the scores over the temperature."""

    vectorizer: CountVectorizerModel
    regression: LogisticRegressionModel
    labels: list[str]
    temperature: float
    threshold: float


def _without_word(text: str, k: int) -> str:
    """The text without every seventh word, from the k-th on: a variant as people write them."""
    return " ".join(w for i, w in enumerate(text.split()) if i % 7 != k)


def _examples(carriers: tuple[str, ...], others: tuple[str, ...], decoys: tuple[str, ...], dropped: tuple[int, ...]) -> list[tuple[str, str]]:
    rows = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            if len(t.split()) <= 8:
                rows += [(family, c.format(t)) for c in carriers]
            else:
                rows += [(family, t)] * 3 + [(family, _without_word(t, k)) for k in dropped]
    return rows + [(UNKNOWN, c.format(t)) for t in others for c in carriers] + [(NONE, x) for x in decoys for _ in carriers]


def train(docs: DataFrame, text_col: str = "text", sample_documents: int = SAMPLE_DOCUMENTS, sample_sentences: int = SAMPLE_SENTENCES) -> LicenceModel:
    """Fits the classifier on templates in carriers and with words left out, on other licences, decoys, and ordinary sentences of docs.

    The sentences are those without a cue in the sample_documents texts with the smallest hashes, up to
    sample_sentences. Every third of them, and the held-out licences, carriers and decoys, calibrate: the
    temperature is the one of TEMPERATURES with the least log loss, the threshold lets FALSE_ALARMS of those pass that have a cue and name no known family. Works on an empty table too.
    """
    spark = docs.sparkSession
    hashed = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("hash", F.xxhash64("text"))
    # the bound is found on hashes alone, so that no task gathers texts of all the others
    bound = hashed.select("hash").orderBy("hash").limit(sample_documents).agg(F.max("hash")).first()[0]
    texts = hashed.where(F.col("hash") <= F.lit(bound)) if bound is not None else hashed.where("false")
    split = texts.select(F.explode(paragraphs(F.col("text"))).alias("p")).select(F.explode(sentences(F.col("p"))).alias("text"))
    sample = split.where((F.length("text") > 0) & ~F.col("text").rlike(CUE)).distinct().orderBy(F.xxhash64("text"), "text").limit(sample_sentences)
    ordinary = [(NONE, r["text"]) for r in sample.collect()]
    schema = "family string, text string"
    learned = spark.createDataFrame(_examples(CARRIERS, OTHERS, DECOYS, (0, 2, 4)) + [x for i, x in enumerate(ordinary) if i % 3], schema).coalesce(1)
    held_out = spark.createDataFrame(_examples(CARRIERS_HELD, OTHERS_HELD, DECOYS_HELD, (1, 5)) + ordinary[::3], schema).coalesce(1)
    labels = [*sorted(TEMPLATES), NONE, UNKNOWN]
    label = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("family")) - 1
    rows = learned.select(label.cast("double").alias("label"), ngrams(F.col("text")).alias("terms")).cache()
    fitted = CountVectorizer(inputCol="terms", outputCol="features", binary=True, minDF=2.0, vocabSize=VOCABULARY).fit(rows)
    vectorizer = CountVectorizerModel.from_vocabulary(sorted(fitted.vocabulary), "terms", "features").setBinary(True)
    vectors = vectorizer.transform(rows).select("label", "features").cache()
    regression = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.3, maxIter=80).fit(vectors)
    vectors.unpersist()
    rows.unpersist()
    raw = _raw(vectorizer, regression, held_out.withColumn("label", label.cast("int"))).cache()
    losses = raw.agg(*[F.avg(-F.log(F.greatest(F.get(softmax(F.col("raw"), t), F.col("label")), F.lit(1e-12)))) for t in TEMPERATURES]).first()
    temperature = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda k: losses[k])]
    best = F.array_max(F.slice(softmax(F.col("raw"), temperature), 1, len(TEMPLATES)))
    alarms = raw.where(F.col("family").isin(NONE, UNKNOWN) & F.col("text").rlike(CUE)).agg(F.percentile(best, F.lit(1 - FALSE_ALARMS))).first()[0]
    raw.unpersist()
    return LicenceModel(vectorizer, regression, labels, temperature, max(LEAST, alarms or 0.0))


def softmax(raw: Column, temperature: float) -> Column:
    scaled = F.transform(raw, lambda x: F.exp((x - F.array_max(raw)) / temperature))
    return _let(scaled, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def _raw(vectorizer: CountVectorizerModel, regression: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Adds the classes' scores to rows with a column text."""
    scored = regression.transform(vectorizer.transform(rows.withColumn("terms", ngrams(F.col("text")))))
    return scored.select(*rows.columns, vector_to_array("rawPrediction").alias("raw"))


def _template_pairs(spark: SparkSession) -> dict[str, list[list[str]]]:
    """Of each family the word pairs of its templates; a template of one word has that word."""
    rows = spark.createDataFrame([(f, t) for f in sorted(TEMPLATES) for t in TEMPLATES[f]], "family string, text string").coalesce(1)
    pairs: dict[str, list[list[str]]] = {}
    for row in rows.select("family", F.array_distinct(_let(terms(F.col("text")), _pairs)).alias("pairs")).collect():
        pairs.setdefault(row["family"], []).append(row["pairs"])
    return pairs


def _as_written(word: str) -> str:
    """A part of a term that stands in the text as it is: of terms that ``terms`` may have joined, the first two letters."""
    return word[:2] if re.fullmatch(rf"(by|attribution)?({'|'.join(NARROWING)})+", word) else word


def anchors(pairs: dict[str, list[list[str]]], stems: tuple[str, ...] = CUE_STEMS) -> list[str]:
    """Parts of words, one of which any sentence has that confirms a template and has none of the stems.

    Such a sentence has CONFIRM of a template's pairs, and none with a stem. Of the pairs left it may lack so many; of one more than that, which are those with the longest words, it has at least one, and so that pair's longest word (of two as long one with a digit, which is rare: "x11", not the German "mit")."""
    found = set()
    for template in [t for ts in pairs.values() for t in ts]:
        left = [max((_as_written(w) for w in pair.split(" ")), key=lambda w: (len(w), w[-1].isdigit())) for pair in template if not any(stem in pair for stem in stems)]
        lacking = len(left) - math.ceil(CONFIRM * len(template))
        if lacking >= 0:
            found |= set(sorted(left, key=lambda w: (-len(w), w))[: lacking + 1])
    return sorted(found)


def anchored(found: list[str]) -> str:
    """A pattern for texts with one of the anchors at the begin of a word."""
    by_letter: dict[str, list[str]] = {}
    for anchor in found:
        # the sign for kelvin is a k in lower case
        by_letter.setdefault(anchor[0].replace("k", "[k\u212a]"), []).append(re.escape(anchor[1:]).replace("k", "[k\u212a]"))
    return f"(?i:(?<![a-z0-9])(?:{'|'.join(f'{first}(?:{"|".join(rest)})' for first, rest in by_letter.items())}))"


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", cue: str = CUE) -> DataFrame:
    """Licences of each document: (id_col, n_paragraphs, n_cues, n_unknown, families, licence, probability), a row per row of docs.

    Paragraphs are blocks of lines (``paragraphs``). A family counts, whether the sentence has a cue or not,
    if its probability reaches the model's threshold and the sentence has CONFIRM of the word pairs of one of
    its templates, or the word of a template of one word; further families of the sentence count at FURTHER of the best one's probability, confirmed likewise.
    n_cues counts the sentences with a cue, n_unknown those of them that name none and are more likely some licence than no licence. families: those that
    count, in order; licence: the most probable of them, the first in order in a tie; null with probability null if there is none. A
    null or empty text has no paragraph. Ids may repeat or be null. Other columns are not looked at.

    Sentences that have neither a cue nor an anchor (``anchors``) confirm no template and add to none of the counts: the classifier need not see them.
    """
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = given.select("row", "id", paragraphs(F.col("text")).alias("p"))
    pairs = _template_pairs(docs.sparkSession)
    asked = f"{cue}|{anchored(anchors(pairs, CUE_STEMS if cue == CUE else ()))}"
    cues = F.filter(F.flatten(F.transform(F.filter("p", lambda x: x.rlike(asked)), sentences)), lambda x: x.rlike(asked))
    found = split.select("row", "id", F.size("p").cast("long").alias("n_paragraphs"), cues.alias("cues"))
    scored = _raw(model.vectorizer, model.regression, found.where(F.size("cues") > 0).select("row", F.explode("cues").alias("text")))
    n = len(TEMPLATES)
    families = F.array(*[F.lit(f) for f in model.labels[:n]])
    shares = scored.select("row", softmax(F.col("raw"), model.temperature).alias("shares"), ngrams(F.col("text")).alias("grams"), F.col("text").rlike(cue).alias("has_cue"))
    # for each family, in order, an array of its templates' word pairs, as one literal
    templates = F.lit([pairs[f] for f in sorted(pairs)])
    likely = F.slice("shares", 1, n)
    named = F.filter(
        F.zip_with(F.zip_with(families, likely, lambda f, p: F.struct((-p).alias("order"), f.alias("family"))), templates, lambda s, ts: F.struct(s.alias("s"), F.exists(ts, lambda t: F.size(F.array_intersect(t, F.col("grams"))) >= CONFIRM * F.size(t)).alias("ok"))),
        lambda x: x["ok"] & (-x["s"]["order"] >= F.lit(FURTHER) * F.array_max(likely)),
    )
    counted = shares.select("row", "has_cue", "shares", F.when(F.array_max(likely) >= model.threshold, F.transform(named, lambda x: x["s"])).otherwise(F.array().cast("array<struct<order:double,family:string>>")).alias("named"))
    unknown = F.col("has_cue") & (F.size("named") == 0) & (F.get("shares", F.lit(n)) < 0.5)
    per_row = counted.groupBy("row").agg(F.count_if("has_cue").alias("n_cues"), F.sum(unknown.cast("long")).alias("n_unknown"), F.sort_array(F.flatten(F.collect_list("named"))).alias("named"))
    out = found.select("row", "id", "n_paragraphs").join(per_row, "row", "left")
    none = F.array().cast("array<string>")
    best = F.get("named", F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "n_paragraphs", F.coalesce("n_cues", F.lit(0)).cast("long").alias("n_cues"), F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("named", lambda x: x["family"]))), none).alias("families"), best["family"].alias("licence"), (-best["order"]).alias("probability"),
    )
