"""Licence scans: a trained paragraph classifier, confirmed by templates.

Everything here is DataFrame operations and Spark ML estimators.

A paragraph is a line, a sentence of it, or a sentence that runs over several
wrapped lines none of which names a family by itself (blank lines end it).  Paragraphs that hold none of the marker words of
the templates are no licence; the others are classified.  The classifier is a
multinomial logistic regression with an L1 penalty on word 1- to 3-grams.  It is
trained on notices generated from the family names (every opening with every name
and some closings), on the families' standard sentences (whole, and each without
its first or last quarter), both in the midst of ordinary words too, and, as the
class ``unknown``, on a sample of the corpus's own paragraphs that no template
confirms: about SAMPLE different texts by a hash, 2 * SAMPLE at most in its order, and of
these SAMPLE_PARAGRAPHS paragraphs in the order of a hash.  A part of both is held back: the
least probability from which on a family is believed is the least one that gives
PRECISION on it; anything below is ``unknown``.  A believed family must be
confirmed: NAME_SHARE of the word pairs of one of its names, or TEXT_SHARE of
those of one of its standard sentences, stand in the paragraph.

Null and empty texts have no paragraph.  Repeated rows give equal rows.  Texts of
any length are read whole.  An empty table gives an empty table.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import write_shared

# Licence families and how notices name them.
FAMILIES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL v3", "AGPL-3.0"],
    "all-rights-reserved": ["All rights reserved"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache-2.0", "Apache Software License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-2-Clause", "BSD-3-Clause", "New BSD License"],
    "cc-by": ["Creative Commons Attribution", "CC BY 4.0", "CC-BY"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial", "CC BY-NC 4.0", "CC BY-NC"],
    "cc-by-nd": ["Creative Commons Attribution-NoDerivatives", "CC BY-ND 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike", "CC BY-SA 4.0", "CC BY-SA"],
    "cc0": ["CC0 1.0 Universal", "CC0", "Public Domain Dedication"],
    "epl": ["Eclipse Public License", "EPL-2.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL v2", "GPLv3", "GPL-3.0"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL v2.1", "LGPL-3.0"],
    "mit": ["MIT License", "MIT Licence", "License: MIT", "License MIT"],
    "mpl": ["Mozilla Public License", "MPL 2.0", "MPL-2.0"],
    "unlicense": ["Unlicense"],
}
# Standard sentences of the families' permission and header texts.
TEXTS = {
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
             "Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\");",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
               "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
            "disclaimer in the documentation and/or other materials provided with the distribution."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License."],
    "gpl": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
            "Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
             "Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
                  "as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
OPENINGS = ["Released under the", "Licensed under the", "Licensed under", "This work is licensed under the", "Distributed under the terms of the",
            "This file is available under the", "This program is free software under the", "SPDX-License-Identifier:", "License:",
            "Permission is granted under the", "Subject to the terms of the", ""]
CLOSINGS = ["", "for details", "see the license file"]
# Words without which no template is confirmed.
MARKERS = ["licen[sc]ed?", "unlicense", "agpl", "gpl", "lgpl", "gplv3", "mpl", "epl", "cc", "cc0", "bsd", "isc", "apache", "gnu",
           "mozilla", "eclipse", "creative", "dedication", "reserved", r"permission\s+(?:is\s+hereby|to\s+use)", r"redistributions?\s+(?:and\s+use|of\s+source|in\s+binary)",
           r"above\s+copyright\s+notice", r"unencumbered\s+software", r"waived\s+all\s+copyright", r"free\s+to\s+copy"]
UNKNOWN = "unknown"
SAMPLE, SAMPLE_PARAGRAPHS, PRECISION, NAME_SHARE, TEXT_SHARE, FOLDS = 1500, 4000, 0.995, 0.99, 0.7, 5
#: n-grams of the classifier at most, and training paragraphs that hold each at least.
NGRAMS, MIN_DF = 1 << 14, 3.0

_MARKED = r"(?iU)(?<![\p{L}\p{N}])(?:" + "|".join(MARKERS) + r")(?![\p{L}\p{N}])"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(words: Column) -> Column:
    """All word 1- to 3-grams."""
    def of(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(
            F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(of(1), of(2), of(3))


def pairs(words: Column) -> Column:
    """Distinct word pairs; of one word, the word."""
    return F.when(F.size(words) == 1, words).when(F.size(words) > 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, 2), " ")))).otherwise(F.array().cast("array<string>"))


def templates() -> list[tuple[str, list[str], float]]:
    """Family, distinct word pairs, and the share of them that confirms it."""
    return [(f, _plain_pairs(t), share) for source, share in ((FAMILIES, NAME_SHARE), (TEXTS, TEXT_SHARE))
            for f, texts in source.items() for t in texts]


def _bound(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def confirmed(words: Column, family: Column | None = None) -> Column:
    """Whether enough pairs of a template (of ``family``, or of any) stand in
    a paragraph."""
    rows = [{"family": f, "want": want, "least": least} for f, want, least in templates()]
    known = F.from_json(F.lit(json.dumps(rows)), "array<struct<family:string,want:array<string>,least:double>>")   # a constant

    def hit(held):
        def enough(t):
            share = F.size(F.array_intersect(held, t["want"])) / F.size(t["want"]) >= t["least"]
            return share if family is None else (t["family"] == family) & share
        return F.exists(known, enough)

    return _bound(words, lambda w: _bound(F.array_union(pairs(w), w), hit))


def _plain_pairs(phrase: str) -> list[str]:
    w = "".join(c if c.isalnum() else " " for c in phrase.lower()).split()
    return sorted({" ".join(p) for p in zip(w, w[1:])}) or w


def pieces(text: Column) -> Column:
    """Distinct paragraphs of a text: lines and their sentences, and the sentences that run
    over lines without a line that a template confirms, these joined by a space."""
    def wrapped(sentence):
        return F.trim(sentence, F.lit("\n")).contains("\n") & F.regexp_like(sentence, F.lit(_MARKED)) & ~F.exists(
            F.split(sentence, "\n"), lambda x: F.when(F.regexp_like(x, F.lit(_MARKED)), confirmed(words_of(x))).otherwise(F.lit(False)))

    flat = F.split(text, r"\n+|(?<=[.!?;])\s+")
    over = F.filter(F.split(text, r"\n[ \t\r]*(?=\n)|(?<=[.!?;])\s+"), wrapped)
    return F.array_distinct(F.concat(flat, F.transform(over, lambda s: F.trim(F.regexp_replace(s, r"\s*\n\s*", " ")))))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row key, paragraph, of marked paragraphs; texts without a marker word
    are not exploded."""
    text = F.col(f"`{text_col}`").cast("string")
    return (docs.filter(F.regexp_like(text, F.lit(_MARKED)))
            .select(F.col(f"`{id_col}`").alias("id"), F.md5(text.cast("binary")).alias("h"), F.explode(pieces(text)).alias("paragraph"))
            .filter(F.regexp_like("paragraph", F.lit(_MARKED))))


def notices(spark: SparkSession) -> DataFrame:
    """Generated notices: paragraph, family."""
    names = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(n).alias("name")) for f, ns in FAMILIES.items() for n in ns)))
    out = spark.range(1).select(names.alias("x")).select("x.*")
    out = out.select("*", F.explode(F.array(*map(F.lit, OPENINGS))).alias("opening"))
    out = out.select("*", F.explode(F.array(*map(F.lit, CLOSINGS))).alias("closing"))
    said = out.select(F.concat_ws(" ", "opening", "name", "closing").alias("paragraph"), "family")
    cuts = []
    for f, texts in TEXTS.items():
        for t in texts:
            w = t.split()
            quarter = len(w) // 4
            cuts += [(f, " ".join(part)) for part in (w, w[quarter:], w[:-quarter])]
    cuts = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("paragraph")) for f, t in cuts)))
    return said.unionByName(spark.range(1).select(cuts.alias("x")).select("x.paragraph", "x.family"))


def training_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """paragraph, family: notices, and ordinary paragraphs as unknown; notices
    stand also next to ordinary words."""
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.filter(text.isNotNull()).select(text.alias("t"), F.xxhash64(text).alias("h"))
    # A share of 2^40 hash values: it stays above 0 for any number of texts.
    share = max(1, min(1 << 40, (SAMPLE << 40) // max(1, texts.count())))
    sample = texts.filter(F.pmod("h", F.lit(1 << 40)) < share).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(2 * SAMPLE)
    plain = sample.select(F.explode(pieces(F.col("t"))).alias("paragraph")).distinct()
    # Without a marker word no template is confirmed: few paragraphs are compared.
    named = F.when(F.regexp_like("paragraph", F.lit(_MARKED)), confirmed(words_of(F.col("paragraph")))).otherwise(F.lit(False))
    plain = plain.filter(~named).withColumn("w", words_of(F.col("paragraph"))).filter(F.size("w") > 0)
    made = notices(docs.sparkSession)
    # One ordinary paragraph per notice, by number.
    some = plain.orderBy(F.xxhash64("paragraph"), "paragraph").limit(SAMPLE_PARAGRAPHS)
    beside = some.withColumn("at", F.row_number().over(Window.orderBy(F.xxhash64("paragraph"), "paragraph"))).select("at", F.slice("w", 1, 8).alias("near"))
    mixed = (made.withColumn("at", F.row_number().over(Window.orderBy("family", "paragraph"))).join(beside, "at")
             .select(F.concat_ws(" ", F.array_join("near", " "), "paragraph").alias("paragraph"), "family"))
    bare = ordinary_uses(docs.sparkSession)
    return made.unionByName(mixed).unionByName(some.select("paragraph", F.lit(UNKNOWN).alias("family"))).unionByName(bare)


def ordinary_uses(spark: SparkSession) -> DataFrame:
    """Marker words outside notices, as unknown."""
    said = ["a driving licence", "licensed to drive", "the license plate", "credit: my cc is full", "send cc to all", "creative people",
            "apache tribe", "mozilla browser", "the eclipse of the sun", "seats are reserved", "rights of way reserved for buses",
            "mit der bahn", "mit dem auto", "a licensed plumber", "public domain name server", "gnu antelope", "the public license office",
            "permission to use the garden", "permission is hereby given to speak", "redistribution of wealth and use of land",
            "you are free to copy the recipe", "the above copyright notice was missing", "this is free software", "free and open to the public"]
    return spark.range(1).select(F.explode(F.array(*(F.lit(s) for s in said for _ in range(6)))).alias("paragraph"), F.lit(UNKNOWN).alias("family"))


class LicenceModel:
    """Classifier, its class names, and the least probability of a family."""

    def __init__(self, stages: PipelineModel, names: list[str], least: float):
        self.stages, self.names, self.least = stages, names, least

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """rows (with ``w``, words) plus best (class) and p (its probability)."""
        scored = self.stages.transform(rows.withColumn("grams", ngrams(F.col("w"))))
        p = vector_to_array("probability")
        names = F.array(*map(F.lit, self.names))
        return scored.withColumn("p", F.array_max(p)).withColumn("best", F.element_at(names, F.array_position(p, F.col("p")).cast("int"))).drop(
            "grams", "features", "rawPrediction", "probability", "prediction")


def fit_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> LicenceModel:
    rows = write_shared(training_rows(docs, id_col, text_col).withColumn("w", words_of(F.col("paragraph"))), "licence-rows")
    names = sorted([*FAMILIES, UNKNOWN])
    label = F.array_position(F.array(*map(F.lit, names)), F.col("family")).cast("double") - 1
    rows = rows.withColumn("label", label).withColumn("grams", ngrams(F.col("w"))).withColumn(
        "fold", F.pmod(F.xxhash64("paragraph"), F.lit(FOLDS)))
    learn = rows.filter("fold <> 0").coalesce(2).cache()
    counts = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=NGRAMS, minDF=MIN_DF, binary=True).fit(learn)
    fitted = LogisticRegression(maxIter=40, regParam=2e-4, elasticNetParam=0.5, family="multinomial").fit(counts.transform(learn))
    learn.unpersist()
    model = LicenceModel(PipelineModel([counts, fitted]), names, 0.0)
    grid = F.explode(F.array(*(F.lit(i / 100) for i in range(30, 100)))).alias("least")
    held = model.probabilities(rows.filter("fold = 0").drop("grams")).filter(F.col("best") != UNKNOWN)
    held = held.select("family", "best", "p", grid).filter("p >= least").groupBy("least").agg(
        F.avg((F.col("family") == F.col("best")).cast("double")).alias("precision")).filter(F.col("precision") >= PRECISION)
    row = held.agg(F.min("least").alias("least")).first()
    model.least = float(row["least"]) if row["least"] is not None else 0.99
    return model


def licence_scan(docs: DataFrame, model: LicenceModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_marked (paragraphs with a marker word), n_licence
    (with a confirmed family), families (sorted, comma-joined)."""
    found = paragraphs(docs, id_col, text_col).withColumn("w", words_of(F.col("paragraph")))
    scored = model.probabilities(found)
    family = F.when((F.col("best") != UNKNOWN) & (F.col("p") >= model.least) & confirmed(F.col("w"), F.col("best")), F.col("best"))
    # Rows of equal id and text are one key, so each has the same result.
    one = (scored.select("id", "h", "paragraph", family.alias("family")).distinct().groupBy("id", "h")
           .agg(F.count(F.lit(1)).alias("n_marked"), F.count("family").alias("n_licence"),
                F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families")))
    text = F.col(f"`{text_col}`").cast("string")
    marked = F.regexp_like(text, F.lit(_MARKED))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.when(marked, F.md5(text.cast("binary"))).alias("h"))
    # Rows without a marker word have no digest; they don't meet in a join.
    side = one.select(F.col("id").alias("oid"), F.col("h").alias("oh"), "n_marked", "n_licence", "families")
    out = rows.filter("h IS NOT NULL").join(side, F.col("id").eqNullSafe(F.col("oid")) & (F.col("h") == F.col("oh")), "left")
    out = out.unionByName(rows.filter("h IS NULL"), allowMissingColumns=True)
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_marked", zero).alias("n_marked"),
                      F.coalesce("n_licence", zero).alias("n_licence"), F.coalesce("families", F.lit("")).alias("families"))
