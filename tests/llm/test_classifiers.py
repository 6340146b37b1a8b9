"""Operators 1 to 4: held-out accuracy on the tables, and odd input."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequery.llm import language_id, licences, quality, toxicity
from framequery.llm.common import table
from tests.llm.fixtures import documents, labels, odd

SF = "/root/testdata/sf0.01"


def area_under_curve(score, label):
    order = np.argsort(np.argsort(score))
    n1, n0 = label.sum(), (1 - label).sum()
    return (order[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_languages_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    rows = by_id(language_id.query(spark, SF))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(rows) == set(truth)
    held = [r for r in rows.values() if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_of_odd_input(spark):
    known = documents(spark, ["the cat and the dog " * 5, "le chat et le chien " * 5] * 8).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    got = language_id.identify(odd(spark), known).collect()
    assert len(got) == 10
    assert {r["doc_id"]: r["lang_pred"] for r in got}[0] == "und"
    assert {r["doc_id"]: r["lang_pred"] for r in got}[2] == "und"
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    assert language_id.identify(odd(spark).limit(0), known).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd(spark), known.limit(0)).collect()} == {"und"}


def test_votes():
    x = np.array([1.0])
    between = {("a", "b"): (np.array([1.0]), 0.0), ("a", "c"): (np.array([-1.0]), 0.0), ("b", "c"): (np.array([-2.0]), 0.0)}
    assert language_id.vote(x, ["a", "b", "c"], between)[0] == "b"
    assert language_id.vote(x, ["a"], {}) == ("a", 1.0)


def test_quality_of_held_out_documents(spark):
    rows = by_id(quality.query(spark, SF))
    truth = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(rows[d]["held_out"] for d in held)
    score, label = np.array([rows[d]["score"] for d in held]), np.array([truth[d] for d in held])
    assert area_under_curve(score, label) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())


def test_discriminant_against_densities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 9))
    means, covs = (rng.normal(size=9), rng.normal(size=9)), []
    for _ in range(2):
        a = rng.normal(size=(9, 9))
        covs.append(a @ a.T + np.eye(9))
    factors = [np.linalg.cholesky(c) for c in covs]
    model = quality.Discriminant((np.log(0.3), np.log(0.7)), means, tuple(np.linalg.inv(f) for f in factors), tuple(float(2 * np.log(np.diag(f)).sum()) for f in factors))
    dense = [-0.5 * (np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m) + np.linalg.slogdet(c)[1]) for m, c in zip(means, covs, strict=True)]
    assert np.allclose(quality.log_odds(model, x), np.clip(np.log(7 / 3) + dense[1] - dense[0], -30, 30))


@pytest.mark.parametrize("rows", [[], [(3, 1, 0)], [(3, 1, 0), (4, None, None), (None, 1, 1), (3, 0, 1)]])
def test_scores_of_odd_input(spark, rows):
    docs, given = odd(spark), labels(spark, rows)
    for got in (quality.quality_scores(docs, given).collect(), toxicity.toxicity_scores(docs, given).collect()):
        assert len(got) == 10
        assert all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1
    assert quality.quality_scores(docs.limit(0), given).count() == 0
    assert quality.keep_quality(docs, given).columns == docs.columns


def test_toxicity_of_held_out_documents(spark):
    rows = by_id(toxicity.query(spark, SF))
    truth = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(rows[d]["held_out"] for d in held)
    score, label = np.array([rows[d]["score"] for d in held]), np.array([truth[d] for d in held])
    assert area_under_curve(score, label) > 0.75
    assert label[score >= 0.7].mean() > 0.9


def test_folding_boundaries_and_exceptions():
    matcher = toxicity.automaton({toxicity.fold("idiot") + " ": 2.0, toxicity.fold("trash") + " ": 1.0, "vequ": 1.0})
    hits = lambda text: toxicity.weighted_hits(text, matcher)[1]
    assert hits("You IDIOT!") == hits("you 1d10t") == hits("іdiоt") == hits("ídiöt") == hits("idiot$$$") == 1
    assert hits("idiotic") == hits("nonidiot") == 0
    assert hits("vequando Vequ") == 2
    assert hits("put it in the trash can") == 0
    assert hits("put it in the trash-can, you trash") == 1
    assert hits("") == 0


def test_weight_by_length():
    short, long = toxicity.measures(2.0, 10), toxicity.measures(2.0, 10_000)
    assert short[1] > long[1]
    assert short[0] == long[0]


WRAPPED = """intro line

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software
   \t
the end of it"""


def test_licence_lines(spark):
    lines = {
        0: "Some text first.\nLicensed under the Apache License, Version 2.0.\nmore text",
        1: "Released under the MIT License.",
        2: "GNU General Public License, version 3.",
        3: "Licensed under CC BY-NC 4.0.",
        4: "She asked for a licence to fish in the river and got it.",
        5: "All rights reserved under the customer license of the shop.",
        6: "Nothing of the kind here.",
        7: "Distributed under the terms of the Mozilla MPL 2.0.",
        8: WRAPPED,
        9: "Permission is hereby granted to everyone to use it AS IS WITHOUT WARRANTY of any kind.",
    }
    docs = documents(spark, [*lines.values(), lines[1]], [*lines, None]).withColumn("p", F.lit(1)).withColumn("line", F.lit(1)).withColumn("g", F.lit("x"))
    model = licences._default_model(spark)
    rows = licences.licence_paragraphs(docs, model).collect()
    found = {(r["doc_id"], r["paragraph"], r["line"]): (r["family"], r["confirmed"]) for r in rows}
    assert found.pop((5, 1, 0))[0] == "unknown"
    assert found.pop((9, 1, 0))[1] is False
    assert found == {
        (0, 1, 2): ("apache", True), (1, 1, 0): ("mit", True), (2, 1, 0): ("gpl", True), (3, 1, 0): ("cc_by_nc", True),
        (7, 1, 0): ("mpl", True), (8, 2, 0): ("mit", True), (None, 1, 0): ("mit", True),
    }
    assert licences.licence_paragraphs(odd(spark), model).count() == 0
    assert licences.licence_paragraphs(odd(spark).limit(0), model).count() == 0

    # every paragraph and line again, without Spark and without the gate
    coef, bias = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    place = {g: k for k, g in enumerate(model.vocabulary.vocabulary)}
    texts = lines | {100 + r["doc_id"]: r["text"] for r in table(spark, SF, "documents").limit(300).collect()}

    def plain(text):
        w = re.findall(r"[^\W_]+", text.lower())
        z = bias + sum((coef[:, place[g]] for g in {*w, *map(" ".join, zip(w, w[1:], strict=False))} if g in place), np.zeros(len(bias)))
        p = np.exp(z - z.max())
        return dict(zip(model.classes, p / p.sum(), strict=True))

    want = {}
    for d, text in texts.items():
        for b, block in enumerate(re.split(r"\n[ \t]*\n\s*", text), 1):
            for at, unit in enumerate([block, *block.split("\n")] if "\n" in block else [block]):
                p = plain(unit)
                if p.pop("none") < 0.5:
                    want[d, b, at] = max(p.values())
    got = {(r["doc_id"], r["paragraph"], r["line"]): r["probability"] for r in licences.licence_paragraphs(documents(spark, list(texts.values()), list(texts)), model).collect()}
    assert all(abs(p - want[k]) < 1e-9 for k, p in got.items())
    assert {k[:2] for k in got} == {k[:2] for k in want}
