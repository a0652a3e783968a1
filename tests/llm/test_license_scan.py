"""The licence scan against a brute-force scorer, and notices as they stand in files."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scribewash.llm import license_scan

DOCS = "doc_id long, text string, family string, line int, h string, words string"


def documents(spark, rows):
    """Further columns have names that the operator uses inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS).coalesce(2)


def brute_paragraphs(text):
    """(paragraph, line or None, words): plain loops."""
    paragraphs, now = [], []
    lines = (text or "").split("\n")
    for line in lines:
        if any(c.isalnum() for c in line):
            now.append(line)
        elif line or not now or True:
            paragraphs.append(now)
            now = []
    paragraphs.append(now)
    return [p for p in paragraphs if p]


def brute_judge(words):
    classes, weights, biases = license_scan.train()
    anchors = {*license_scan.ANCHORS, license_scan.MIT}
    z = list(biases)
    seen = set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            gram = words[i : i + n]
            if any(x in anchors for x in gram) and tuple(gram) not in seen:
                seen.add(tuple(gram))
                for c, v in enumerate(weights.get(" ".join(gram), [0.0] * len(classes))):
                    z[c] += v
    top = max(z)
    family = classes[z.index(top)]
    said = " ".join("mit" if w == license_scan.MIT else w for w in words).split()
    similarity = 0.0
    for t in license_scan.TEMPLATES.get(family, ()):
        w = ["mit" if x == license_scan.MIT else x for x in license_scan.words_of(t)]
        n = min(5, len(w))
        shingles = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        own = {tuple(said[i : i + n]) for i in range(len(said) - n + 1)}
        similarity = max(similarity, len(shingles & own) / len(shingles))
    return family, 1 / sum(math.exp(v - top) for v in z), similarity


HEADERS = {
    "gpl": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
    " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n * This program is distributed in the hope"
    " that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n"
    " * GNU General Public License for more details.",
    "apache-2.0": '// Licensed under the Apache License, Version 2.0 (the "License");\n// you may not use this file except in compliance with the License.\n'
    "// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n",
    "mit": "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n"
    "# in the Software without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
    "# copies of the Software, and to permit persons to whom the Software is\n# furnished to do so, subject to the following conditions:",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:",
    "agpl": "You should have received a copy of the GNU Affero General Public License\nalong with this program. If not, see <https://www.gnu.org/licenses/>.",
}


def test_wrapped_headers_are_confirmed(spark):
    names = list(HEADERS)
    rows = [(i, "int x;\n\n" + HEADERS[f] + "\n\nint main() {}") for i, f in enumerate(names)]
    got = license_scan.license_scan(documents(spark, rows)).collect()
    for i, f in enumerate(names):
        mine = [r for r in got if r.doc_id == i and r.line is None]
        assert any(r.family == f and r.confirmed for r in mine), (f, mine)
        assert all(r.family in (f, "unknown") for r in mine), mine


def test_short_forms(spark):
    texts = ["Released under MIT", "License: GPLv3", "fahren mit dem Bus", "MIT researchers met", "# SPDX-License-Identifier: Apache-2.0\nimport os", "Released under the Unlicense."]
    got = {(r.doc_id, r.family) for r in license_scan.license_scan(documents(spark, list(enumerate(texts)))).where("line IS NULL").collect()}
    assert got == {(0, "mit"), (1, "gpl"), (3, "unknown"), (4, "apache-2.0"), (5, "public-domain")}


def test_rows_of_one_id_are_all_kept(spark):
    mit, cc = license_scan.TEMPLATES["mit"][4], license_scan.TEMPLATES["cc-by"][1]
    got = license_scan.license_scan(documents(spark, [(1, mit), (1, cc), (1, cc), (None, mit)])).collect()
    assert sorted((str(r.doc_id), r.family) for r in got) == [("1", "cc-by"), ("1", "mit"), ("None", "mit")]


def test_against_brute_force(spark):
    rng = random.Random(3)
    filler = "the mit of domain Rights MIT a word LICENSE gplv3 \n \n\n * cc commons , und 4 copyright".split(" ")
    texts = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice([x for ts in license_scan.TEMPLATES.values() for x in ts] + list(license_scan.NOT_LICENCES)).split()
            cut = sorted(rng.sample(range(len(t) + 1), 2)) if len(t) > 1 else [0, 1]
            parts += rng.choices(filler, k=rng.randrange(6)) + t[cut[0] : cut[1]] + [rng.choice(["\n", "\n\n", "\n*\n", " "])]
        texts.append(" ".join(parts))
    anchors = {*license_scan.ANCHORS, license_scan.MIT}
    want = []
    for i, t in enumerate(texts):
        for p in brute_paragraphs(t):
            units = [(None, license_scan.words_of("\n".join(p)))] + ([(k, license_scan.words_of(x)) for k, x in enumerate(p)] if len(p) > 1 else [])
            for line, words in units:
                family, probability, similarity = brute_judge(words)
                if anchors.isdisjoint(words):
                    assert family == "unknown" and similarity == 0  # nothing is lost by skipping it
                    continue
                if line is None or similarity >= 0.8:
                    want.append((i, line is None, family, round(probability, 6), round(similarity, 6)))
    got = [(r.doc_id, r.line is None, r.family, round(r.probability, 6), round(r.similarity, 6)) for r in license_scan.license_scan(documents(spark, list(enumerate(texts)))).collect()]
    assert sorted(got) == sorted(want)


def test_unseen_versions_of_notices(spark):
    """Notices with words lost and put in: nine of ten find their family, everyday sentences none."""
    rng = random.Random(77)
    hit = n = 0
    for family, ts in license_scan.TEMPLATES.items():
        for t in ts:
            if len(t.split()) >= 8:
                words = [w for w in license_scan.words_of(t) if rng.random() > 0.1] + rng.choices(["our", "work", "here", "text"], k=4)
                hit, n = hit + (brute_judge(words)[0] == family), n + 1
    assert hit >= 0.9 * n
    everyday = ["The fishing license was issued in May.", "Her rights were violated by the court.", "The domain of the function is open.", "We ask for your permission to proceed."]
    assert all(brute_judge(license_scan.words_of(t))[0] == "unknown" for t in everyday)


@pytest.mark.parametrize("rows", [[(1, None), (2, ""), (None, "\n\n"), (3, "word " * 50000), (4, "\n" * 50000 + "License: MIT")], []])
def test_edges(spark, rows):
    got = license_scan.license_scan(documents(spark, rows)).collect()
    assert [(r.doc_id, r.family) for r in got] == ([(4, "mit")] if rows else [])


def test_plan_has_no_python(spark):
    plan = license_scan.license_scan(documents(spark, [(1, "license")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_words_split_alike(spark):
    for text in ("Licensed under CC BY-NC 4.0, Version 12.10 Ünï", "MIT, (MIT) MITx mit GPLv3 MIT", "a_MIT_b"):
        assert spark.range(1).select(license_scan._words(F.lit(text))).first()[0] == license_scan.words_of(text)
