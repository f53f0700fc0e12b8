"""Licence families of paragraphs: a trained n-gram classifier, confirmed against templates.

Features are word unigrams and bigrams in which a licensing word (CUES) occurs, present
or not. A multinomial logistic regression over them, trained here on notices
and template texts of each family and on sentences that only sound like them, gives
each paragraph's logits. A temperature, fitted on notices held out of training,
calibrates the probabilities; below SURE the family is unknown, as it is where the
class of other text wins. A prediction is confirmed when at least SIMILAR of the
bigrams of one of the family's templates occur in the paragraph.

A paragraph is a line, and also a run of lines up to a blank one, joined without their comment
signs, as texts and headers are often wrapped. A joined paragraph is reported if it is confirmed and
none of its lines is for the same family; it then stands for those of its lines that
are nearest to that family, under the number of its first line with a licensing word. One without any licensing word has no feature, so
it always is other text; that is the only reason to pass over a paragraph, and
whole texts without such a word are passed over at once. DataFrame functions and
Spark's own ML only; nothing is shuffled but the training rows and, by a number of
its own, each text's licence paragraphs, so hot sources and copies do not matter.

A null or empty text has no paragraphs and gives no rows. Repeated rows repeat. Null
ids are kept.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import picked, table

SURE = 0.6
SIMILAR = 0.6
VOCABULARY = 8000
OTHER, UNKNOWN = "other", "unknown"
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)

CUES = tuple(
    "affero agpl apache attribution boost bsd by-nc by-sa cc cc-by cc-by-nc cc-by-sa cc0 commons confidential copyleft copyright creative domain dual eclipse epl expat gnu gpl gplv2 gplv3 granted"
    " isc lesser lgpl licence licences licensed licensee license licenses licensing mit mozilla mpl noncommercial permission permitted proprietary redistribution redistributions reserved"
    " rights sharealike spdx-license-identifier sublicense unlicense warranties warranty zlib".split()
)
NAMES = {
    "mit": ("MIT License", "MIT licence", "Expat License", "MIT"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License", "GNU GPL", "GPLv3", "GPL-3.0-or-later", "GPLv2", "GNU General Public License version 2"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "LGPL-2.1", "LGPL license"),
    "agpl": ("GNU Affero General Public License", "GNU AGPL", "AGPL-3.0", "Affero GPL"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-2-Clause", "New BSD License", "simplified BSD license"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL license"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY license", "Creative Commons Attribution License"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution ShareAlike 4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution NonCommercial 4.0"),
    "cc0": ("CC0 1.0", "CC0", "Creative Commons Zero", "CC0 public domain dedication"),
    "isc": ("ISC License", "ISC"),
    "unlicense": ("Unlicense", "The Unlicense"),
    "epl": ("Eclipse Public License", "EPL-2.0", "Eclipse Public License 2.0"),
}
NOTICES = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.",
    "Distributed under the {}.", "This program is free software under the {}", "License: {}", "SPDX-License-Identifier: {}", "This project is available under the terms of the {}.",
    "The code is covered by the {}; see the LICENSE file.", "Published under the {} by its authors", "{} license",
)
TEXTS = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2.0": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "gpl": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",),
    "lgpl": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "agpl": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "cc0": ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law CC0",),
    "proprietary": ("All rights reserved. Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.", "Copyright the company. All rights reserved.", "This material is proprietary and confidential and may not be disclosed"),
}
OTHERS = (
    "He lost his driving licence last year.", "The driver showed her license and registration.", "The city granted permission to build a new school.", "Human rights were discussed at the meeting.",
    "MIT researchers published a study on batteries.", "She studied at MIT in Boston.", "The apache helicopter landed near the village.", "The eclipse was seen from Spain.", "Lawyers argued about copyright and fair use.",
    "A licensed electrician should do this work.", "The lake is home to gnus and zebras, and the gnu is a large antelope.", "The restaurant has a liquor license.", "The warranty lasts two years and covers parts.",
    "All seats were reserved for members.", "They gave the project a boost.", "The creative team met on Monday.", "The House of Commons voted on the bill.", "Permission slips are due on Friday.", "The domain name expired in May.",
    "He was granted a patent for the licensing of the technology.", "The license plate was hidden.", "The attribution of the painting is disputed.", "Mozilla released a new browser under pressure from users.", "The proprietary technology gives the firm an edge.",
    "Confidential sources told the paper that the minister would resign.", "Redistribution of wealth was the main topic.", "Which license should I choose for my project?", "The licensee pays a fee to the licensor every year.", "Voting rights are reserved by law to citizens.",
)


#: Comment signs at a line's begin and end.
SIGNS_BEFORE, SIGNS_AFTER = r"(?m)^[ \t]*(?:(?:/\*+|\*+/?|//+!?|#+|;+|--+|<!--|%+|dnl\b|REM\b|\(\*)[ \t]*)+|^[ \t]+", r"(?m)[ \t\r]*(?:\*+/|-->|\*\))?[ \t\r]*$"


def words_of(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"[^a-z0-9.-]+", " ")
    return F.filter(F.transform(F.split(spaced, " "), lambda w: F.regexp_replace(w, r"^[.-]+|[.-]+$", "")), lambda w: w != "")


def bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat_ws(" ", w, words[i + 1]))).otherwise(F.array().cast("array<string>"))


def grams(words: Column) -> Column:
    """Unigrams and bigrams with a licensing word."""
    cue = lambda w: w.isin(*CUES)
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: (i + 1 < F.size(words)) & (cue(words[i]) | cue(F.get(words, i + 1))))
    return F.array_distinct(F.concat(F.filter(words, cue), F.transform(pairs, lambda i: F.concat_ws(" ", words[i], words[i + 1]))))


def examples() -> list[tuple[str, str, bool]]:
    """(family, text, held out) of the training rows, the same each time."""
    rows = [(f, n.format(name)) for f, names in NAMES.items() for name in names for n in NOTICES]
    for family, texts in TEXTS.items():
        for text in texts:
            w = text.split()
            rows += [(family, text)] * 4 + [(family, " ".join(w[i : i + 14])) for i in range(0, max(1, len(w) - 8), 6)]
    rows += [(OTHER, x) for x in OTHERS for _ in range(3)] + [(OTHER, c) for c in CUES if c not in ("agpl", "lgpl", "unlicense", "cc0", "gplv2", "gplv3")] + [(OTHER, "no such words here")] * 10
    return [(f, t, i % 5 == 0) for i, (f, t) in enumerate(rows)]


def pairs_of(text: str) -> list[str]:
    """As bigrams(words_of(text)), each once."""
    words = [w for x in re.split(r"[^a-z0-9.-]+", text.lower()) if (w := x.strip(".-"))]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def templates() -> list[tuple[str, list[list[str]]]]:
    """Each family with the bigrams of its texts; a paragraph of the family holds most of one."""
    texts = {f: [*names, *[x.format(n) for n in names for x in NOTICES[:6]]] for f, names in NAMES.items()} | {"proprietary": ["all rights reserved"]}
    return [(f, [p for t in [*x, *TEXTS.get(f, ())] if (p := pairs_of(t))]) for f, x in texts.items()]


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows, spelled out in the plan."""
    names = [x.split()[0] for x in schema.split(", ")]
    told = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(told), f"array<struct<{schema.replace(' ', ': ')}>>".replace(",: ", ", "))))


def softmax(logits: Column, temperature: float) -> Column:
    powers = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


@functools.lru_cache(maxsize=4)
def trained(spark: SparkSession) -> tuple[PipelineModel, list[str], float]:
    """The model, its families in order, and the temperature; trained once a session."""
    rows = literal(spark, examples(), "family string, text string, held boolean").select("family", "held", words_of(F.col("text")).alias("words")).select("family", "held", grams(F.col("words")).alias("grams")).cache()
    stages = [
        StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc"),
        CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, binary=True),
        LogisticRegression(maxIter=60, regParam=0.0005, family="multinomial"),
    ]
    model = Pipeline(stages=stages).fit(rows.filter("not held"))
    families = list(model.stages[0].labels)
    model = PipelineModel(model.stages[1:])
    held = model.transform(rows.filter("held")).select("family", vector_to_array("rawPrediction").alias("logits"))
    at = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("int")
    loss = held.agg(*[F.avg(-F.log(F.greatest(F.element_at(softmax(F.col("logits"), t), at), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]).first()
    rows.unpersist()
    return model, families, TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda i: loss[str(i)])]


def classified(paragraphs: DataFrame) -> DataFrame:
    """paragraphs (with a text column `paragraph`) with family, probability, similarity and confirmed; other text goes."""
    spark = paragraphs.sparkSession
    model, families, temperature = trained(spark)
    # Generators of one row: a filter is not pushed below them, which would compute the words anew for each word.
    known = paragraphs.select("*", F.explode(F.array(words_of(F.col("paragraph")))).alias("words")).select("*", F.explode(F.array(grams(F.col("words")))).alias("grams"))
    scored = model.transform(known).withColumn("shares", softmax(vector_to_array("rawPrediction"), temperature))
    best = F.array_max("shares")
    family = F.element_at(F.array(*map(F.lit, families)), F.array_position("shares", best).cast("int"))
    told = scored.withColumns({"probability": best, "nearest": family}).filter(F.col("nearest") != OTHER)
    # One row a family, fixed above.
    held = literal(spark, templates(), "nearest string, templates array<array<string>>")
    overlap = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect("pairs", t)) / F.size(t)))
    out = told.withColumn("pairs", bigrams(F.col("words"))).join(F.broadcast(held), "nearest", "left").withColumn("similarity", F.coalesce(overlap, F.lit(0.0)))
    sure = F.col("probability") >= SURE
    return out.withColumns({"family": F.when(sure, F.col("nearest")).otherwise(UNKNOWN), "confirmed": sure & (F.col("similarity") >= SIMILAR)})


def license_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph (its number), family, nearest, probability, similarity, confirmed."""
    cue = r"(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(c) for c in CUES) + r")(?![a-z0-9])"
    chosen = picked(docs, doc_id=id_col, text=text_col).filter(F.col("text").rlike(cue))
    bare = F.regexp_replace(F.regexp_replace("text", SIGNS_BEFORE, ""), SIGNS_AFTER, "")
    # Pieces keep the line feeds that end them, which number the lines.
    pieces = F.split(bare, r"(?<=\n\n)(?!\n)")
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n")))
    cut = chosen.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("text", "\n").alias("lines"), pieces.alias("pieces")).withColumn("feeds", F.transform("pieces", feeds))
    line = lambda x, i: F.struct(i.alias("number"), i.alias("low"), (i + 1).alias("high"), F.lit(False).alias("joined"), x.alias("paragraph"))

    def block(x: Column) -> Column:
        low = F.aggregate(F.slice("feeds", F.lit(1), x["i"]), F.lit(0), lambda n, y: n + y)
        first = F.array_position(F.transform(F.split(x["piece"], "\n"), lambda y: y.rlike(cue)), F.lit(True)).cast("int") - 1
        return F.struct((low + first).alias("number"), low.alias("low"), (low + feeds(x["piece"]) + 1).alias("high"), F.lit(True).alias("joined"), F.replace(x["piece"], F.lit("\n"), F.lit(" ")).alias("paragraph"))

    several = F.filter(F.transform("pieces", lambda x, i: F.struct(x.alias("piece"), i.alias("i"))), lambda x: x["piece"].rlike(r"\S[^\n]*\n[^\n]*\S") & x["piece"].rlike(cue))
    both = F.concat(F.filter(F.transform("lines", line), lambda x: x["paragraph"].rlike(cue)), F.transform(several, block))
    told = classified(cut.select("doc_id", "row", F.explode(both).alias("s")).select("doc_id", "row", "s.*"))
    names = ("number", "low", "high", "joined", "family", "nearest", "probability", "similarity", "confirmed")
    found = told.groupBy("row", "doc_id").agg(F.collect_list(F.struct(*names)).alias("found"))
    within = lambda x, y: (y["low"] <= x["low"]) & (x["low"] < y["high"])
    alone = lambda y: y["joined"] & y["confirmed"] & ~F.exists("found", lambda x: ~x["joined"] & x["confirmed"] & (x["family"] == y["family"]) & within(x, y))
    found = found.withColumns({"single": F.filter("found", lambda x: ~x["joined"]), "blocks": F.filter("found", alone)})
    left = F.filter("single", lambda x: x["confirmed"] | ~F.exists("blocks", lambda y: (x["nearest"] == y["family"]) & within(x, y)))
    return found.select("doc_id", F.explode(F.concat(left, "blocks")).alias("s")).select("doc_id", F.col("s.number").alias("paragraph"), *[f"s.{x}" for x in names[4:]])


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_paragraphs(table(spark, sf_dir, "documents"))
