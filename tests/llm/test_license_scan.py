"""Licence paragraphs: held-out accuracy, unknowns, defined cases."""

from pyspark.sql import functions as F

from tessera.llm import license_scan as S

HELD = [
    ("mit", "This little library is released under the MIT License, have fun."), ("apache-2.0", "Files here are licensed under the Apache License, Version 2.0 (see below)"), ("gpl", "The tool is distributed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Photos: licensed under CC BY-NC 4.0."), ("cc-by", "Text is licensed under CC BY 4.0."), ("cc-by-sa", "Content is licensed under CC BY-SA 4.0"), ("bsd", "Use of this source code is governed by a BSD License that can be found in the LICENSE file."),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License 2.0"), ("lgpl", "you may link it under the GNU Lesser General Public License"), ("agpl", "The server is under the GNU Affero General Public License"),
    ("isc", "Available under the ISC License."), ("proprietary", "Copyright 2020 Example Corp. All rights reserved."),
]
NOT = ["The judge granted his license back.", "A permitted use of the domain is farming.", "Copyright law is hard.", "No such word at all."]


def test_held_out(spark):
    rows = [(i, f"some words before\n{t}\nand after") for i, (_, t) in enumerate(HELD)] + [(100 + i, t) for i, t in enumerate(NOT)]
    got = S.license_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: r for r in got if r.confirmed}
    right = [i for i, (f, _) in enumerate(HELD) if i in found and found[i].family == f and found[i].paragraph == 1]
    assert len(right) >= len(HELD) - 1, [(HELD[r.doc_id], r) for r in got if r.doc_id not in right and r.doc_id < 100]
    assert not [r for r in got if r.doc_id >= 100 and r.confirmed]


def test_probabilities_are_calibrated(spark):
    model, families, temperature = S.trained(spark)
    held = [(f, t) for f, t, out in S.examples() if out]
    rows = S.literal(spark, held, "truth string, paragraph string")
    scored = S.classified(rows.filter(F.col("truth") != S.OTHER)).select("truth", "nearest", "probability").collect()
    accuracy = sum(r.truth == r.nearest for r in scored) / len(scored)
    assert accuracy > 0.9 and abs(accuracy - sum(r.probability for r in scored) / len(scored)) < 0.1
    assert temperature in S.TEMPERATURES and S.OTHER in families


def test_defined_cases(spark):
    rows = [(None, "Released under the MIT License."), (1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, "word " * 50_000 + "\nReleased under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("x")).withColumn("features", F.lit(1))
    got = sorted((r.doc_id or 0, r.paragraph) for r in S.license_paragraphs(df).collect() if r.confirmed)
    assert got == [(0, 0), (3, 0), (3, 0), (4, 1)]
    assert S.license_paragraphs(df.limit(0)).count() == 0


def test_native(spark):
    plan = S.license_paragraphs(spark.createDataFrame([(1, "MIT License")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_wrapped_texts(spark):
    import textwrap

    wrap = lambda t, sign, before="", after="": "\n".join([before, *[sign + x for x in textwrap.wrap(t, 60)], after])
    rows = [
        (1, "mit", wrap(S.TEXTS["mit"][0], " * ", "/*", " */") + "\nint x;"),
        (2, "bsd", "code\n\n" + wrap(S.TEXTS["bsd"][0], "# ")),
        (3, "apache-2.0", wrap(S.TEXTS["apache-2.0"][1], "// ")),
        (4, "gpl", "This is under the GNU General\nPublic License, version 3."),
        (5, "isc", wrap(S.TEXTS["isc"][0], "")),
    ]
    got = S.license_paragraphs(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()
    for i, family, text in rows:
        mine = [r for r in got if r.doc_id == i and r.confirmed]
        assert [r.family for r in mine] == [family], (i, [r for r in got if r.doc_id == i])
        assert "\n" in text and mine[0].paragraph < len(text.split("\n"))
    assert next(r.paragraph for r in got if r.doc_id == 2 and r.confirmed) == 3
    two = S.license_paragraphs(spark.createDataFrame([(1, "Released under the MIT License.\nLicensed under CC BY 4.0.")], "doc_id long, text string")).collect()
    assert {(r.paragraph, r.family) for r in two if r.confirmed} == {(0, "mit"), (1, "cc-by")}
