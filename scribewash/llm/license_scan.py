"""Licence scan by a trained paragraph classifier, in Spark expressions only.

A paragraph is what stands between lines without a letter or digit, its wrapped lines joined, so that a
notice in a comment is one paragraph whatever its line ends and comment signs. Each paragraph that holds a
licence word is classified by a sparse multinomial logistic regression over word 1- to 3-grams; families and
"unknown" are its classes, calibrated by a temperature on templates that the calibrated model never saw. A
predicted family is confirmed by comparison with its templates (five-word shingles, four fifths of a template).
Lines of a paragraph of several lines are judged, too, and returned if they are confirmed by themselves: a
notice may be one line of a longer text.

Every feature of the model holds a licence word (``ANCHORS``, or MIT in capitals), and the biases alone make
"unknown" the best class (checked when the model is built). So a paragraph without a licence word is unknown
by construction; such paragraphs have no row.

Equal word sequences are judged once: the model meets distinct ones only, however many rows hold them. The
model is trained on the driver from the fixed templates below; its weights (a bounded table) and the templates
enter the plan as one JSON literal each. No Python runs on the executors.

Defined results: null and empty texts have no paragraph and no row; a paragraph predicted unknown is
returned with family ``unknown``, unconfirmed; equal probabilities go to the family that sorts first; rows
that are equal in id, place and words are returned once, rows of one id with other words each by themselves;
null ids are rows of a null id; an empty table gives no rows; other columns are ignored. A paragraph is held
in one row: texts must fit a task's memory several times.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UNKNOWN = "unknown"
SHINGLE, SIMILARITY = 5, 0.8
#: Bound of the broadcast weight table.
MAX_FEATURES = 6000

# Notices of each licence family, by paragraph.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "Released under MIT.",
        "License: MIT",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see",
        "Released under the GPLv3.",
        "License: GPLv3",
        "Licensed under GPL",
        "Licensed under the GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
        "Licensed under the LGPLv2.1.",
        "License: LGPLv3",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see",
        "Licensed under the AGPLv3.",
        "License: AGPLv3",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "public-domain": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this unencumbered software, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Inc. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}
# Paragraphs that hold licence words and are no licence.
NOT_LICENCES = (
    "He lost his driving license last year and had to take the bus.",
    "The city council issued a new license to the restaurant on the corner.",
    "You need permission from the owner before you enter the garden.",
    "The warranty covers parts and labour for two years.",
    "The copyright dispute was settled out of court.",
    "Students study at MIT and other universities.",
    "Apache helicopters flew over the valley.",
    "The apache tribe lived in the south.",
    "She works as a creative director for a commons project.",
    "The public domain of the lake is open to all visitors.",
    "Poetic license lets the author change the order of events.",
    "The license plate was covered in mud.",
    "Eclipse of the moon was seen in the public park.",
    "Mozilla held a meeting about the web last week.",
    "The general public was not allowed inside.",
    "Redistribution of wealth is a matter of debate.",
    "The rights of the tenants were reserved in the contract.",
    "A proprietary blend of herbs and spices.",
    "Permission denied while opening the file.",
    "Confidential sources told the paper about the plan.",
    "The license agreement between the two networks ends in March.",
    "Copyright law protects authors for seventy years after death.",
    "A fishing permit or license is required on the river.",
    "The bank gave permission to redistribute the profits.",
    "His dealer offered an extended warranty for the used car.",
    "The House of Commons debated the bill until midnight.",
    "Domain names are sold by the registry every year.",
    "The company keeps its proprietary recipe in a safe.",
    "Unauthorized access to the building is punished.",
    "She holds a pilot licence and flies every weekend.",
    "GNU herds cross the river in July.",
    "The public library is free and open to everyone under the general rules of the town.",
    "The software is distributed to schools at a lower price.",
    "Freedom of speech and other rights are set out in the constitution.",
    "The notice on the door said that the shop had closed.",
    "A license fee pays for public radio and television.",
    "He reserved all the rooms in the hotel.",
    "The university licensed the patent to a start-up.",
    "CC me on the email, please, and add the minutes.",
    "MIT researchers built a new kind of battery.",
    "ICH FAHRE MIT DEM ZUG NACH HAUSE",
)
# Licence words, one of which every feature of the model contains; figures stand as 0.
ANCHORS = (
    "license", "licensed", "licence", "licenced", "licenses", "copyright", "permission", "permitted", "warranties", "warranty",
    "redistribution", "redistributions", "redistribute", "rights", "spdx", "apache", "gnu", "gpl", "lgpl", "agpl", "bsd",
    "mozilla", "mpl", "cc", "cc0", "commons", "isc", "eclipse", "epl", "domain", "unencumbered", "proprietary", "unauthorized",
    "gplv0", "gpl0", "lgplv0", "lgpl0", "agplv0", "agpl0", "unlicense", "sublicense", "licensing",
)
#: The word for MIT in capitals; "mit" itself is an everyday word in German.
MIT = "mit0"
_WORD_EDGE = "[^\\p{L}\\p{N}]"
_FORMS = "|".join(a.replace("0", "[0-9]+") for a in ANCHORS)
ANCHOR_RE = rf"(?:^|{_WORD_EDGE})(?:(?i:{_FORMS})|MIT|(?i:mit[0-9]+))(?:{_WORD_EDGE}|$)"
_MIT_RE = rf"(^|{_WORD_EDGE})MIT(?={_WORD_EDGE}|$)"
_NO_TEXT_RE = r"(?m)^[^\p{L}\p{N}\n]+$"


def words_of(paragraph: str) -> list[str]:
    """Lower-cased words; numbers are one word, 0. The plan's expressions split alike."""
    marked = re.sub(r"(^|[\W_])MIT(?=[\W_]|$)", rf"\g<1>{MIT}", paragraph)
    low = re.sub(r"[0-9]+", "0", marked.lower())
    return [w for w in re.split(r"[^a-z0-9À-￿]+", low) if w]


def grams(words: list[str]) -> set[str]:
    """The word 1- to 3-grams that hold a licence word."""
    anchors = {*ANCHORS, MIT}
    out = set()
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            if not anchors.isdisjoint(words[i : i + n]):
                out.add(" ".join(words[i : i + n]))
    return out


#: Names that are a licence wherever they stand.
_TELLING = ("spdx", "gplv0", "gpl0", "lgplv0", "lgpl0", "agplv0", "agpl0", "unlicense")
_FILLER = "the a of and to in for with on this that is was by from as at it or".split()


def _examples() -> list[tuple[str, int, set[str]]]:
    """(family, number of the template, features): templates and their noisy versions, as they come in corpora:
    words lost, words around, one after the other."""
    rng = random.Random(11)
    out: list[tuple[str, int, set[str]]] = []
    labelled = [(f, i, t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)] + [(UNKNOWN, i, t) for i, t in enumerate(NOT_LICENCES)]
    for family, i, t in labelled:
        words = words_of(t)
        for k in range(10):
            noisy = [w for w in words if k == 0 or rng.random() > 0.08]
            if k > 2:
                noisy = rng.choices(_FILLER, k=rng.randint(0, 6)) + noisy + rng.choices(_FILLER, k=rng.randint(0, 6))
            if k > 7 and family != UNKNOWN:  # two paragraphs of one notice without a blank line between
                noisy += words_of(rng.choice(TEMPLATES[family]))
            out.append((family, i, grams(noisy)))
    for i, anchor in enumerate(a for a in (*ANCHORS, MIT) if a not in _TELLING):  # another licence word alone decides nothing
        for _ in range(6):
            out.append((UNKNOWN, i, grams(rng.choices(_FILLER, k=4) + [anchor] + rng.choices(_FILLER, k=4))))
    return out + [(UNKNOWN, i, set()) for i in range(60)]


def _learn(x: np.ndarray, y: np.ndarray, k: int, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression: full-batch Adam with a little L2. (weights, biases)."""
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    target = np.eye(k, dtype=np.float32)[y]
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        g = (_softmax(x @ w + b) - target) / len(x)
        for at, (p, d) in enumerate(((w, x.T @ g + 2e-5 * w), (b, g.sum(axis=0)))):
            m, v = moments[2 * at], moments[2 * at + 1]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@functools.lru_cache(maxsize=1)
def train() -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(classes, weights of each feature, biases), already divided by the calibrated temperature."""
    examples = _examples()
    classes = sorted({f for f, _, _ in examples})
    count: dict[str, int] = {}
    for _, _, g in examples:
        for s in g:
            count[s] = count.get(s, 0) + 1
    names = sorted((s for s, c in count.items() if c >= 2), key=lambda s: (-count[s], s))[:MAX_FEATURES]
    at = {s: i for i, s in enumerate(names)}
    x, y = np.zeros((len(examples), len(names)), np.float32), np.array([classes.index(f) for f, _, _ in examples])
    for r, (_, _, g) in enumerate(examples):
        x[r, [at[s] for s in g if s in at]] = 1
    # Temperature: least loss on whole templates (every third of a class) that a first model did not see.
    held = np.array([i % 3 == 2 for _, i, _ in examples])
    w, b = _learn(x[~held], y[~held], len(classes))
    loss = lambda t: -np.log(_softmax((x[held] @ w + b) / t)[np.arange(held.sum()), y[held]] + 1e-12).mean()
    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    w, b = _learn(x, y, len(classes))
    if classes[int(b.argmax())] != UNKNOWN:
        raise RuntimeError("a paragraph without a licence word would not be unknown")
    return classes, {s: [round(float(v) / temperature, 4) for v in w[i]] for s, i in at.items()}, [round(float(v) / temperature, 4) for v in b]


def _literal(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as one JSON literal: stays a JVM plan."""
    one = df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r"))
    return one.select("r.*")


def _words(c: Column) -> Column:
    low = F.regexp_replace(F.lower(F.regexp_replace(c, _MIT_RE, f"$1{MIT}")), "[0-9]+", "0")
    return F.filter(F.split(low, r"[^a-z0-9À-￿]+"), lambda w: w != "")


def _ngrams(words: Column, n: int) -> Column:
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


def _features(words: Column) -> Column:
    """The 1- to 3-grams around the licence words: ``grams``."""
    n = F.size(words)
    known = F.array(*[F.lit(a) for a in (*ANCHORS, MIT)])
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_contains(known, F.element_at(words, i)))

    def around(i: Column) -> Column:
        spans = [F.struct((i - back).alias("a"), F.lit(size).alias("n")) for size in (1, 2, 3) for back in range(size)]
        return F.transform(F.filter(F.array(*spans), lambda s: (s["a"] >= 1) & (s["a"] + s["n"] - 1 <= n)), lambda s: F.array_join(F.slice(words, s["a"], s["n"]), " "))

    return F.array_distinct(F.flatten(F.transform(at, around)))


def licence_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, paragraph, line, words, h): paragraphs with a licence word, and their lines with one if there are several.

    ``line`` is null for a whole paragraph; h is a digest of the words.
    """
    split = F.split(F.regexp_replace(F.col(text), _NO_TEXT_RE, ""), "\n\n+")
    rows = docs.where(F.col(text).rlike(ANCHOR_RE)).select(F.col(doc_id).alias("id"), F.posexplode(split).alias("paragraph", "p"))
    rows = rows.where(F.col("p").rlike(ANCHOR_RE))
    lines = F.filter(F.transform(F.split("p", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("p"))), lambda x: x["p"].rlike(ANCHOR_RE))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("line"), F.col("p").alias("p")))
    units = F.when(F.contains(F.trim(F.col("p"), F.lit("\n")), F.lit("\n")), F.concat(whole, lines)).otherwise(whole)
    found = rows.select("id", "paragraph", F.explode(units).alias("u")).select("id", "paragraph", "u.line", _words(F.col("u.p")).alias("words"))
    return found.withColumn("h", F.sha2(F.array_join("words", " "), 256)).dropDuplicates(["id", "paragraph", "line", "h"])


def judge(words: DataFrame) -> DataFrame:
    """(h, words) of distinct word sequences to (h, family, probability, similarity)."""
    classes, weights, biases = train()
    table = _literal(words, [{"f": f, "w": w} for f, w in weights.items()], "f:string,w:array<double>")
    features = words.select("h", F.explode(_features(F.col("words"))).alias("f"))
    scored = features.join(F.broadcast(table), "f").groupBy("h").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(classes))])
    logits = F.array(*[F.struct((F.lit(b) + F.coalesce(F.col(f"s{i}"), F.lit(0.0))).alias("z"), F.lit(-i).alias("at"), F.lit(c).alias("family")) for i, (c, b) in enumerate(zip(classes, biases))])
    judged = words.select("h").join(scored.hint("merge"), "h", "left").select("h", logits.alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - top["z"]))
    judged = judged.select("h", top["family"].alias("family"), (1 / total).alias("probability"))

    # Template comparison: the share of a template's shingles that the paragraph holds.
    plain = lambda w: ["mit" if x == MIT else x for x in w]
    templates = [(f"{f}/{i}", f, plain(words_of(t))) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    sizes = sorted({min(SHINGLE, len(w)) for _, _, w in templates})
    rows = []
    for name, family, w in templates:
        n = min(SHINGLE, len(w))
        shingles = sorted({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)})
        rows += [{"t": name, "fam": family, "n": len(shingles), "s": s} for s in shingles]
    known = _literal(words, rows, "t:string,fam:string,n:int,s:string")
    own = F.transform("words", lambda w: F.when(w == MIT, "mit").otherwise(w))
    held = words.select("h", own.alias("w")).select("h", F.explode(F.array_distinct(F.concat(*[_ngrams(F.col("w"), n) for n in sizes]))).alias("s"))
    shares = held.join(F.broadcast(known), "s").groupBy("h", "fam", "t").agg((F.count(F.lit(1)) / F.max("n")).alias("similarity"))
    best = shares.groupBy("h", F.col("fam").alias("family")).agg(F.max("similarity").alias("similarity"))
    out = judged.join(best.hint("merge"), ["h", "family"], "left")
    return out.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, paragraph, line, family, probability, similarity, confirmed): every paragraph with a licence word
    (line null), and the lines of longer paragraphs that are confirmed by themselves."""
    found = materialise(licence_paragraphs(docs, doc_id, text), "licence-paragraphs")  # used three times; small against the texts
    judged = materialise(judge(found.groupBy("h").agg(F.any_value("words").alias("words"))), "licences")
    out = found.drop("words").join(judged.hint("merge"), "h").withColumn("confirmed", F.col("similarity") >= SIMILARITY)
    out = out.where(F.col("line").isNull() | (F.col("confirmed") & (F.col("family") != UNKNOWN)))
    return out.select(F.col("id").alias(doc_id), "paragraph", "line", "family", "probability", "similarity", "confirmed")
