"""Licence paragraphs: generated notices, standard texts, ordinary text, edges, and the whole
scan against plain Python with the exported weights."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topictone.llm import licenses as L
from topictone.llm.queries import op8_licence_paragraphs


@pytest.fixture(scope="module")
def model(spark, sf01):
    return L.fit_licences(spark.read.parquet(f"{sf01}/documents.parquet"))


def test_pairs_and_confirmation(spark):
    df = spark.createDataFrame([("Released under the MIT-License!",), ("mit dem Auto",), ("License",), ("",)], "t string")
    w = L.words_of(F.col("t"))
    got = df.select(L.pairs(w).alias("p"), L.confirmed(w).alias("any"), L.confirmed(w, F.lit("bsd")).alias("bsd")).collect()
    assert got[0].p == ["released under", "under the", "the mit", "mit license"]
    assert [r["any"] for r in got] == [True, False, False, False] and not any(r.bsd for r in got)
    assert got[2].p == ["license"] and got[3].p == []
    grams = df.limit(1).select(L.ngrams(w).alias("g")).first().g
    assert "mit license" in grams and "the mit license" in grams and len(grams) == 5 + 4 + 3


def test_classes_of_unseen_notices(spark, model):
    rows = [("mit", "You may use it under the MIT License as is"), ("apache", "licensed under the apache license version 2 0"),
            ("bsd", "This is licensed under the BSD 3-Clause License, see file"), ("gpl", "GPL v2 or later"),
            ("lgpl", "This program uses GNU Lesser General Public License"), ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
            ("cc-by-sa", "Photos: CC BY-SA 4.0"), ("all-rights-reserved", "(c) 2020 Someone. All rights reserved."),
            ("unknown", "Mit dem Auto"), ("unknown", "Eclipse of the sun"), ("unknown", "Licensed under the Foo Terms"),
            ("unknown", "the cc was paid"), ("unknown", "")]
    df = spark.createDataFrame(rows, "want string, paragraph string").withColumn("w", L.words_of(F.col("paragraph")))
    said = F.when((F.col("p") >= model.least) & L.confirmed(F.col("w"), F.col("best")), F.col("best")).otherwise("unknown")
    assert all(r.want == r.said for r in model.probabilities(df).select("want", said.alias("said")).collect())


def test_edges(spark, model):
    rows = [(1, "Intro text.\nReleased under the MIT License.\nMore."), (1, "Intro text.\nReleased under the MIT License.\nMore."),
            (2, None), (3, ""), (4, "mit der bahn " * 20_000), (5, "wort " * 30_000 + "\nLicensed under CC BY-NC 4.0.\nAll rights reserved."),
            (None, "Licensed under the Apache License, Version 2.0."), (6, "\n\n \n")]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, families string, h int")
    got = sorted(((r.doc_id, r.n_marked, r.n_licence, r.families) for r in L.licence_scan(df, model).collect()), key=str)
    want = [(1, 1, 1, "mit")] * 2 + [(2, 0, 0, ""), (3, 0, 0, ""), (4, 0, 0, ""), (5, 2, 2, "all-rights-reserved,cc-by-nc"), (6, 0, 0, ""),
                                     (None, 1, 1, "apache")]
    assert got == sorted(want, key=str)
    assert L.licence_scan(df.limit(0), model).count() == 0
    fresh = L.fit_licences(df.limit(0))  # without any text the notices alone are learnt
    assert L.licence_scan(df, fresh).filter("doc_id = 1").first().families == "mit"


def test_query_finds_the_lines(spark, sf01):
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache",
             "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "All rights reserved.": "all-rights-reserved"}
    got = {r.doc_id: r.families for r in op8_licence_paragraphs(spark, sf01).collect()}
    docs = spark.read.parquet(f"{sf01}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert sum(map(bool, got.values())) > 0
    for d in docs:
        assert got[d.doc_id] == ",".join(sorted({f for line, f in lines.items() if line in d.text}))


WRAPPED = {
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
            "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "gpl": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as\n"
           "    published by the Free Software Foundation, either version 3 of the\n    License, or (at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "
           "\"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\n"
           "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\n"
           "copies or substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\n"
           "are met:\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
           "copyright notice and this permission notice appear in all copies.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the\npublic domain.",
}
ORDINARY = ["The committee gave permission to use the hall for any purpose, provided that the fee is paid.", "Redistribution of seats and\nuse of rooms.",
            "You are free to copy my notes.\nThe above copyright notice is wrong.", "He had a licence to drive,\nbut no car."]


def test_wrapped_standard_texts_are_found_and_ordinary_ones_left_alone(spark, model):
    rows = [(f, f"Some heading\n\n{t}\n\nint main()") for f, t in WRAPPED.items()] + [("", t) for t in ORDINARY]
    got = L.licence_scan(spark.createDataFrame(rows, "doc_id string, text string"), model).collect()
    assert Counter((r.doc_id, r.families) for r in got) == Counter((f, f) for f, _ in rows)


def test_pieces(spark):
    def of(t):
        return spark.createDataFrame([(t,)], "t string").select(L.pieces(F.col("t")).alias("p")).first().p
    assert of("a b.  c\ncc e\n\n\nf") == ["a b.", "c", "cc e", "f", "c cc e"] and of("c\nd e") == ["c", "d e"]
    assert of("the\nMIT License") == ["the", "MIT License"] and of("the MIT\nLicense") == ["the MIT", "License", "the MIT License"]
    assert of("one line") == ["one line"] and of("") == [""] and of("x\n \ny") == ["x", " ", "y"]


def _brute(text, model):
    """n_marked, n_licence, families of a text, with the weights of the fitted model."""
    counts, fitted = model.stages.stages
    at = {g: i for i, g in enumerate(counts.vocabulary)}
    weight, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    flat = re.split(r"\n+|(?<=[.!?;])\s+", text)
    marked = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(L.MARKERS) + r")(?![^\W_])")

    def named(w, family=None):
        held = {*w, *map(" ".join, zip(w, w[1:]))}
        return any(family in (f, None) and len(held & set(want)) / len(want) >= share for f, want, share in L.templates())

    over = [s for s in re.split(r"\n[ \t\r]*(?=\n)|(?<=[.!?;])\s+", text) if "\n" in s.strip("\n") and marked.search(s)
            and not any(marked.search(x) and named(re.findall(r"[^\W_]+", x.lower())) for x in s.split("\n"))]
    parts = {*flat, *(re.sub(r"\s*\n\s*", " ", s).strip(" ") for s in over)}
    n_marked, n_licence, families = 0, 0, set()
    for part in filter(marked.search, parts):
        n_marked += 1
        w = re.findall(r"[^\W_]+", part.lower())
        grams = {" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        z = bias + weight[:, [at[g] for g in grams if g in at]].sum(1)
        p = [math.exp(x - max(z)) for x in z]
        best, p = model.names[p.index(max(p))], max(p) / sum(p)
        if best != "unknown" and p >= model.least and named(w, best):
            n_licence += 1
            families.add(best)
    return n_marked, n_licence, ",".join(sorted(families))


def test_the_whole_scan_equals_plain_python(spark, sf001, model):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text")
    more = [(10**6 + i, t) for i, t in enumerate([*WRAPPED.values(), *ORDINARY, "\n\n".join(WRAPPED.values())])]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: (r.n_marked, r.n_licence, r.families) for r in L.licence_scan(df, model).collect()}
    for r in df.collect():
        assert got[r.doc_id] == _brute(r.text or "", model), r.doc_id
