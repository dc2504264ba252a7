"""License scans with DataFrame functions only.

A multinomial logistic regression over sparse word n-grams names the licence family of a paragraph; templates of the
family then confirm it. It is trained here, in plain Python on the driver, on seeded variations of the templates and on
paragraphs of a bounded sample of documents, and its few weights go into the plan as literals. Scanning is one narrow
stage without a shuffle: paragraphs that hold no word of any feature have the score of the biases, which is that of no
licence, and leave early; the others are scored by higher-order functions.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lines_by_hash, sample_by_hash

# Notices of public licences by family.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Released under the GNU GPL, version 2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
UNKNOWN, NONE = "unknown", "none"
UNNAMED = ["Licensed under the {0} License.", "Released under the {0} License, version {1}.", "This work is licensed under the terms of the {0} Public License, version {1}.", "SPDX-License-Identifier: {0}-{1}.0", "Use of this software is governed by the {0} license agreement.", "All rights reserved. Distributed under the {0} licence."]

#: Words are runs of these after lower-casing A to Z; full stops and hyphens at their ends do not count.
SPLIT = "[^a-z0-9.+-]+"
SAMPLE_DOCS, VARIATIONS, EPOCHS, RATE, L1 = 200, 25, 4, 0.5, 2e-3
CONFIRM = 0.6
MOST_FEATURES = 400


def words_of(text: str) -> list[str]:
    """The driver's twin of words_column()."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in (x.strip(".+-") for x in re.split(SPLIT, lower)) if w]


def words_column(text: Column) -> Column:
    """One pattern gives what splitting and trimming gives: from the first to the last letter or digit of a run."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit("[a-z0-9](?:[a-z0-9.+-]*[a-z0-9])?"), 0)


def grams(words: list[str]) -> list[str]:
    """Distinct words and pairs of neighbours."""
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def training_set(negatives: list[str], seed: int = 11) -> list[tuple[list[str], str]]:
    """(n-grams, class): templates with words left out or added around them, unnamed licences, and other paragraphs."""
    rng = random.Random(seed)
    plain = [w for x in negatives[:200] for w in words_of(x)] or ["text"]
    names = ["Acme", "Blue Oak", "Northwind", "Zeta", "Open Data", "Artistic", "Public Domain", "Contoso", "Eclipse", "Academic", "Example", "Foo"]
    out = []

    def around(words: list[str]) -> list[str]:
        words = [w for w in words if rng.random() > 0.05] or words
        return [rng.choice(plain) for _ in range(rng.choice([0, 0, 1, 3]))] + words + [rng.choice(plain) for _ in range(rng.choice([0, 0, 2, 6]))]

    for family, texts in TEMPLATES.items():
        for text in texts:
            out += [(grams(words_of(text)), family)] + [(grams(around(words_of(text))), family) for _ in range(VARIATIONS)]
    for text in UNNAMED:
        out += [(grams(around(words_of(text.format(rng.choice(names), rng.randint(1, 9))))), UNKNOWN) for _ in range(2 * VARIATIONS)]
    out += [(grams(words_of(x)), NONE) for x in negatives]
    rng.shuffle(out)
    return out


#: A line end within a hard-wrapped paragraph: behind a line of 40 to 119 characters that ends no sentence, and before one
#: that holds more than comment marks. Marks themselves are no words. The line end is asked for first, so that the long
#: look behind is taken at line ends only.
WRAP = r"""(?=[ \t\r]*\n)(?<=[^\n]{39}[^\s.:;!?])(?<![.:;!?]["')\]])(?<![^\n]{120})[ \t\r]*\n(?=[^\n]*[^\s#*/;%!<>-])"""


def marked(text: Column) -> Column:
    """The text with a mark at the head of each line that goes on with the paragraph of the one before."""
    return F.regexp_replace(F.translate(text, "\1", " "), WRAP, "\n\1")


def paragraphs(marked_text: Column) -> Column:
    """Structs of paragraph (the number of its first line, from 0) and line (its lines, joined by spaces)."""
    first = F.filter(F.transform(F.split(marked_text, "\n"), lambda x, i: F.when(~F.startswith(x, F.lit("\1")), i)), lambda i: i.isNotNull())
    return F.arrays_zip(first.alias("paragraph"), F.split(F.replace(marked_text, F.lit("\n\1"), F.lit(" ")), "\n").alias("line"))


def constant(value: object, kind: str) -> Column:
    """A list or dict as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def once(df: DataFrame) -> DataFrame:
    """df, whose columns the optimizer does not write out again where they are used: a generator parts the projections."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


class Model:
    """Weights by class and n-gram, biases, and the probability below which a family counts as unknown."""

    def __init__(self, negatives: list[str]):
        templates = {f: [set(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()}
        alike = lambda x: max(len(set(words_of(x)) & t) / len(t) for ts in templates.values() for t in ts)
        negatives = [x for x in negatives if alike(x) < CONFIRM]
        rows = training_set(negatives)
        hold, learn = rows[::5], [r for i, r in enumerate(rows) if i % 5]
        common = Counter(g for gs, c in learn if c == NONE for g in gs)
        n_none = max(1, sum(c == NONE for _, c in learn))
        held = Counter(g for gs, c in learn if c != NONE for g in gs)
        # Features are n-grams of licences that other paragraphs hardly hold.
        kept = {g for g, n in held.most_common(MOST_FEATURES) if n >= 10 and common[g] / n_none < 0.01}
        self.classes = [*TEMPLATES, UNKNOWN, NONE]
        self.bias = {c: 0.0 for c in self.classes}
        self.weights: dict[str, dict[str, float]] = {c: defaultdict(float) for c in self.classes}
        for epoch in range(EPOCHS):
            for gs, c in learn:
                own = [g for g in gs if g in kept]
                p = self.probabilities(own)
                for k in self.classes:
                    step = RATE / (1 + epoch) * ((k == c) - p[k])
                    self.bias[k] += step
                    for g in own:
                        w = self.weights[k][g] + step
                        self.weights[k][g] = math.copysign(max(0.0, abs(w) - L1 * RATE / (1 + epoch)), w)
        self.weights = {k: {g: round(w, 4) for g, w in ws.items() if abs(w) >= 1e-3} for k, ws in self.weights.items()}
        self.features = sorted({g for ws in self.weights.values() for g in ws})
        # Calibration: the least cut above which at least 99 of 100 held rows that are given a family have it.
        given = sorted(((p[k], k == c) for gs, c in hold for p in [self.probabilities(gs)] for k in [max(p, key=p.get)] if k not in (UNKNOWN, NONE)), reverse=True)
        right, self.cut = 0, 0.5
        for n, (p, ok) in enumerate(given, 1):
            right += ok
            if right / n >= 0.99:
                self.cut = max(0.5, min(self.cut, p))

    def probabilities(self, gs: list[str]) -> dict[str, float]:
        score = {k: self.bias[k] + sum(self.weights[k].get(g, 0.0) for g in gs) for k in self.classes}
        most = max(score.values())
        e = {k: math.exp(v - most) for k, v in score.items()}
        total = sum(e.values())
        return {k: v / total for k, v in e.items()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_DOCS, lines: int = 12, chars: int = 600) -> Model:
    """Paragraphs of at most `rows` documents, those with the least hash of their ids, stand for what is no licence: so many
    lines of each and characters of a line, drawn by hash from the whole text."""
    ids = sample_by_hash(docs.select(F.col(id_col).alias("__id")).where("__id is not null"), "__id", rows).distinct()
    drawn = lines_by_hash(F.col("__id"), F.coalesce(F.col(text_col), F.lit("")), lines, chars)
    text = docs.join(F.broadcast(ids), docs[id_col] == F.col("__id")).select("__id", F.transform(drawn, lambda s: s.x).alias("p"))
    return Model([p for r in sorted(text.toLocalIterator(), key=lambda r: (r[0], r[1])) for p in r.p if p.strip()])


def find_licenses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRM) -> DataFrame:
    """One row per paragraph that is a licence notice: doc_id, paragraph (from 0), family, probability, similarity, confirmed.

    A paragraph is a line, or the lines of a hard-wrapped one (WRAP), and has the number of its first line. family is `unknown` for a notice of no known family, and for one whose probability is below
    the calibrated cut. similarity is the largest share of a template's distinct words that the paragraph holds, over the
    family's templates (0 for unknown); confirmed says that it is at least `confirm`. Null and empty texts have no
    notices; repeated rows give theirs each; null ids stay null; extra columns are not read.
    """
    whole = once(docs.select(F.col(id_col).cast("long").alias("doc_id"), marked(F.coalesce(F.col(text_col), F.lit(""))).alias("text")))
    lines = whole.select("doc_id", F.inline(paragraphs(F.col("text"))).alias("paragraph", "line"))
    single = sorted({w for g in model.features for w in g.split(" ")})
    rare = [w for w in single if w in set(model.features)]
    if not all(any(w in rare for w in g.split(" ")) for g in model.features):
        rare = single
    words = once(lines.select("doc_id", "paragraph", words_column(F.col("line")).alias("words"))).where(F.arrays_overlap("words", constant(rare, "array<string>")))
    pairs = "transform(slice(words, 1, greatest(size(words) - 1, 0)), (w, i) -> concat(w, ' ', words[i + 1]))"
    found = once(words.select("*", F.array_intersect(F.concat("words", F.expr(pairs)), constant(model.features, "array<string>")).alias("grams")))
    weights = constant([{"class": k, "bias": model.bias[k], "weights": model.weights[k]} for k in model.classes], "array<struct<class:string,bias:double,weights:map<string,double>>>")
    score = lambda c: F.aggregate("grams", c.bias, lambda a, g: a + F.coalesce(F.try_element_at(c.weights, g), F.lit(0.0)))
    scored = once(found.select("doc_id", "paragraph", F.array_distinct("words").alias("words"), F.transform(weights, lambda c: F.struct(score(c).alias("score"), c["class"].alias("class"))).alias("scores")))
    best = once(scored.select("*", F.array_max("scores").alias("best"))).where(F.col("best.class") != NONE)
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s.score - F.col("best.score")))
    named = once(best.select("doc_id", "paragraph", "words", F.col("best.class").alias("class"), (1 / total).alias("probability")))
    named = once(named.select("*", F.when(F.col("probability") >= model.cut, F.col("class")).otherwise(UNKNOWN).alias("family")))
    templates = constant([{"family": f, "words": sorted(set(words_of(t)))} for f, ts in TEMPLATES.items() for t in ts], "array<struct<family:string,words:array<string>>>")
    own = F.filter(templates, lambda t: t.family == F.col("family"))
    alike = F.aggregate(own, F.lit(0.0), lambda a, t: F.greatest(a, F.size(F.array_intersect("words", t.words)) / F.size(t.words)))
    return once(named.select("doc_id", "paragraph", "family", "probability", alike.alias("similarity"))).select("*", (F.col("similarity") >= confirm).alias("confirmed"))
