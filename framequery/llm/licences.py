"""Licence scans: a trained paragraph classifier over word n-grams.

Sparse logistic regression over word one- and two-grams tells licence families
from each other and from other text.  Its class `unknown` is licence language
of no known family; a prediction of a family below a cut-off calibrated on
lines that the classifier had not seen falls to it.  A family is confirmed when
enough of the n-grams of one of its templates are in the paragraph.

A paragraph is a block of lines between blank lines, and each of its lines by
itself: a wrapped text is judged as a whole, a line in the midst of others alone.
Blocks without a word that the trained weights need for any licence class are
passed over, which changes no result.

Everything is a DataFrame or SQL function; the logistic regression is Spark's own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequery.llm.common import table

#: Common English words.
COMMON = "of the and to in is that it was for on with as by at this be are or an not all any you may use from which a no has"
#: Lines by which licences are known, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache Software License 2.0.",
        "This project is available under the terms of the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license, see the file LICENSE.",
    ],
    "gpl": [
        "This program is free software under the GNU General Public License, version 3.",
        "GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "Distributed under the GNU GPL v2.",
    ],
    "lgpl": [
        "This library is free software under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Licensed under the GNU Lesser General Public License.",
        "This library is distributed under the GNU LGPL version 3.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software under the GNU Affero General Public License as published by the Free Software Foundation.",
        "Released under the AGPL v3, the GNU Affero General Public License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Licensed under the ISC license.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Distributed under the terms of the MPL 2.0, the Mozilla license.",
    ],
    "cc_by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Released under CC BY 3.0, Creative Commons Attribution.",
    ],
    "cc_by_nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Released under CC BY-NC 3.0, Creative Commons NonCommercial.",
    ],
    "cc_by_sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Released under CC BY-SA 3.0, Creative Commons ShareAlike.",
    ],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "The author has placed this work in the public domain.",
    ],
    "unknown": [
        "Licensed under the terms of the vendor license agreement.",
        "All rights reserved under the customer license.",
        "Use is subject to license terms.",
        "Distributed under a proprietary license, see the license file.",
        "License available on request from the copyright holder.",
        "Copyright holders reserve all rights; no part may be reproduced without written permission.",
        "This material is licensed for internal use only under the evaluation license.",
        "See the LICENSE file for the terms and conditions of use and distribution.",
        "Permission is granted to anyone to use it for any purpose, provided as is, without warranty of any kind.",
        "This software is provided as is without any express or implied warranty.",
    ],
    "none": [
        "the driver showed a license at the door and went on",
        "copyright was discussed at length in the second chapter",
        "permission to enter the garden was given to all",
        "the public met in the general hall under free skies",
        "she redistributed the seeds among the neighbours",
        "version two of the story was longer than the first",
        "the software was slow and the users were not happy",
        "creative people work in common rooms",
        COMMON,
        "she asked for a licence to fish in the river and got it",
        "the notice on the door was in all the languages of the house",
        "he was granted leave and had to copy the list of names",
        "source and form of the work are described in the following terms",
    ],
}
#: Training rows of each template line.
VARIANTS = 24
FOLDS = 3
KNOWN = sorted(set(TEMPLATES) - {"none", "unknown"})
LINE_END = r"\r\n|\n|\r"
BLANK = r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*"


@dataclass(frozen=True)
class Model:
    """A paragraph classifier; ``gate``: words one of which every licence text
    has (none: all paragraphs are scored)."""

    classes: list[str]
    vocabulary: CountVectorizerModel
    regression: LogisticRegressionModel
    cut: float
    gate: list[str] | None


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def known_words(text: Column, vocabulary: list[str]) -> Column:
    """The words in order, those in none of the vocabulary's n-grams blank."""
    known = sorted({w for gram in vocabulary for w in gram.split()})
    return F.transform(words(text), lambda w: F.when(w.isin(known), w).otherwise(F.lit("")))


def grams(word: Column) -> Column:
    """Distinct one- and two-grams of words that are not blank."""
    ends = F.greatest(F.size(word) - 1, F.lit(0))
    pair = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit(" "), b)).otherwise(F.lit(""))
    two = F.zip_with(F.slice(word, 1, ends), F.slice(word, 2, ends), pair)
    return F.array_distinct(F.array_remove(F.concat(word, two), ""))


def template_lines(spark: SparkSession) -> DataFrame:
    """(family, line, fold): a family's lines go to the folds in turn."""
    lines = [(f, line, k % FOLDS) for f, own in TEMPLATES.items() for k, line in enumerate(own)]
    text = "stack(%d, %s) AS (family, line, fold)" % (len(lines), ", ".join(f"'{f}', '{v}', {k}" for f, v, k in lines))
    return spark.range(1).selectExpr(text)


def training_paragraphs(spark: SparkSession) -> DataFrame:
    """(family, fold, g): VARIANTS altered copies of every template line, with a
    part of its words left out and other words around it, and of class `none` a
    third as many rows of a few words of the same lines, which alone are no
    licence, and rows of common words in any order."""
    rows = template_lines(spark).select("family", "line", "fold", F.explode(F.sequence(F.lit(1), F.lit(VARIANTS))).alias("k"))
    roll = lambda *c: F.pmod(F.xxhash64("line", "k", *c), F.lit(100))
    kept = F.filter(words(F.col("line")), lambda w, i: (F.col("k") == 1) | (roll(i) >= roll(F.lit("rate")) * F.lit(0.25)))
    few = F.filter(words(F.col("line")), lambda w, i: roll(i, F.lit("few")) < F.least(F.lit(50), F.ceil(300 / F.size(words(F.col("line"))))))
    pad = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("w"), F.xxhash64("line", "k", i).cast("string")))
    padded = F.when(F.col("k") % 3 == 0, F.concat(F.slice(pad, 1, 3), kept, F.slice(pad, 4, 3))).otherwise(kept)
    whole = rows.select("family", "fold", grams(padded).alias("g"))
    parts = rows.where("k % 3 = 1").select(F.lit("none").alias("family"), "fold", grams(F.transform(few, lambda w: w)).alias("g"))
    apart = F.array_distinct(F.filter("g", lambda w: ~F.contains(w, F.lit(" "))))
    common = F.array(*map(F.lit, COMMON.split()))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: common[F.pmod(F.xxhash64("id", i), F.size(common)).cast("int")])
    prose = spark.range(20 * VARIANTS).select(F.lit("none").alias("family"), F.pmod("id", F.lit(FOLDS)).cast("int").alias("fold"), grams(drawn).alias("g"))
    return whole.unionByName(parts.withColumn("g", apart)).unionByName(prose).where(F.size("g") > 0)


def train(spark: SparkSession) -> Model:
    """Logistic regression with an L1 part on all lines; the cut-off comes from
    FOLDS more that each leave out a fold of the lines."""
    classes = sorted(TEMPLATES)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")) - 1
    rows = training_paragraphs(spark).withColumn("label", index.cast("double")).coalesce(1).cache()
    vocabulary = CountVectorizer(inputCol="g", outputCol="features", binary=True, minDF=3.0).fit(rows)
    made = vocabulary.transform(rows).cache()
    plan = LogisticRegression(family="multinomial", regParam=1e-3, elasticNetParam=0.5, maxIter=30, standardization=False)
    unseen = []
    for fold in range(FOLDS):
        found = plan.fit(made.where(F.col("fold") != fold)).transform(made.where((F.col("fold") == fold) & (F.col("family") != "none")))
        unseen.append(found.select("label", "prediction", F.array_max(vector_to_array("probability")).alias("p")))
    model = plan.fit(made)
    cut = cut_off(reduce(DataFrame.unionByName, unseen), classes)
    made.unpersist()
    rows.unpersist()
    return Model(classes, vocabulary, model, cut, gate_words(model, vocabulary.vocabulary, classes.index("none")))


def cut_off(found: DataFrame, classes: list[str]) -> float:
    """The probability that best parts right predictions of a known family from
    others: of (label, prediction, p) of unseen lines, whose number is fixed."""
    known = [float(classes.index(c)) for c in KNOWN]
    rows = found.where(F.col("prediction").isin(known)).select((F.col("label") == F.col("prediction")).alias("right"), "p").collect()
    right, wrong = (np.array([r["p"] for r in rows if r["right"] == side]) for side in (True, False))
    grid = np.arange(0.2, 0.96, 0.05)
    worth = [(right >= c).sum() / max(len(right), 1) + (wrong < c).sum() / max(len(wrong), 1) for c in grid]
    return float(grid[int(np.argmax(worth))])


def gate_words(model: LogisticRegressionModel, vocabulary: list[str], none: int) -> list[str] | None:
    """Words one of which is in every text that the model gives a class but `none`.

    Without n-grams that speak for a class more than for `none`, the intercepts
    make `none` likelier than all others.  Left out are so many of them, common words first and then
    those that speak least, that all of these together do not make up for that.
    """
    coef, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    ahead = -np.log(np.exp(np.delete(bias - bias[none], none)).sum())
    if ahead <= 0:
        return None
    margin = (coef - coef[none]).max(0)
    word = [max(gram.split(), key=len) for gram in vocabulary]
    rising = sorted(np.flatnonzero(margin > 0).tolist(), key=lambda k: (word[k] not in COMMON.split(), margin[k]))
    spare = int(np.searchsorted(np.cumsum(margin[rising]), ahead * 0.999))
    return sorted({word[k] for k in rising[spare:]})


@lru_cache(maxsize=4)
def _default_model(spark: SparkSession) -> Model:
    return train(spark)


def template_share(g: Column, family: Column, vocabulary: list[str]) -> Column:
    """The largest share of the n-grams of a template of the family that are in ``g``."""
    known = {w for gram in vocabulary for w in gram.split()}
    shares = F.lit(0.0)
    for name in KNOWN:
        own = []
        for line in TEMPLATES[name]:
            w = [v if v in known else "" for v in re.findall("[a-z0-9]+", line.lower())]
            held = sorted({*filter(None, w), *(f"{u} {v}" for u, v in zip(w, w[1:], strict=False) if u and v)})
            template = F.expr("array(%s)" % ", ".join(f"'{g}'" for g in held))
            own.append(F.size(F.array_intersect(g, template)) / len(held))
        shares = F.when(family == name, F.greatest(*own)).otherwise(shares)
    return shares


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(at, doc_id, paragraph, line, g): the known n-grams of each block of lines
    (line 0) that has a word of the gate, and of its lines (from 1) if it has several."""
    cut = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", BLANK)).alias("paragraph", "block"))
    lines = F.transform(F.split("block", LINE_END), lambda v: known_words(v, model.vocabulary.vocabulary))
    # The number beside the words keeps Spark from computing them once more in the filter.
    cut = cut.select(F.monotonically_increasing_id().alias("at"), "doc_id", (F.col("paragraph") + 1).cast("long").alias("paragraph"), lines.alias("w"))
    if model.gate is not None:
        cut = cut.where(F.arrays_overlap(F.flatten("w"), F.array(*map(F.lit, model.gate))))
    whole = F.array(F.flatten("w"))
    units = cut.select("at", "doc_id", "paragraph", F.posexplode(F.when(F.size("w") > 1, F.concat(whole, F.col("w"))).otherwise(whole)).alias("line", "w"))
    return units.select("at", "doc_id", "paragraph", F.col("line").cast("long").alias("line"), grams(F.col("w")).alias("g"))


def licence_paragraphs(docs: DataFrame, model: Model | None = None, overlap: float = 0.6) -> DataFrame:
    """doc_id, paragraph, line, family, probability, template_overlap, confirmed.

    One row for each paragraph that reads as licence text: blocks between blank
    lines, numbered from 1, with ``line`` 0, or a line of one (from 1).  A block
    of several lines is given as one if it holds more of a template than any of
    its lines, or else its lines that read so are given; those that are
    likelier none than all classes together are left out.  Null and empty texts and empty tables give no rows; a null
    doc_id is kept; repeated rows give repeated results; other columns are ignored.
    """
    model = model or _default_model(docs.sparkSession)
    units = model.vocabulary.transform(paragraphs(docs.select("doc_id", "text"), model))
    scored = model.regression.transform(units).select("at", "doc_id", "paragraph", "line", "g", vector_to_array("probability").alias("p"))
    others = F.array(*[F.struct(F.col("p")[k].alias("p"), F.lit(c).alias("c")) for k, c in enumerate(model.classes) if c != "none"])
    found = scored.where(F.col("p")[model.classes.index("none")] < 0.5).withColumn("best", F.array_max(others))
    found = found.select("at", "doc_id", "paragraph", "line", "g", F.col("best.c").alias("likely"), F.col("best.p").alias("probability"))
    found = found.withColumn("share", template_share(F.col("g"), F.col("likely"), model.vocabulary.vocabulary)).drop("g")
    block = Window.partitionBy("at")
    whole, parts = F.max(F.when(F.col("line") == 0, F.col("share"))).over(block), F.max(F.when(F.col("line") > 0, F.col("share"))).over(block)
    found = found.withColumn("as_one", F.coalesce(whole > parts, parts.isNull())).where((F.col("line") == 0) == F.col("as_one"))
    family = F.when(F.col("probability") >= model.cut, F.col("likely")).otherwise("unknown")
    share = F.col("share")
    return found.select("doc_id", "paragraph", "line", family.alias("family"), "probability", share.alias("template_overlap"), (share >= overlap).alias("confirmed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_paragraphs(table(spark, sf_dir, "documents"))
