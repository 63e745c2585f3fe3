"""Licence scans by a trained paragraph classifier (operator 3, DataFrame functions only).

A multinomial logistic regression over word uni- and bigrams (trained here in numpy, made sparse
by an L1 penalty) gives each paragraph a class: a licence family, ``unknown`` for other licence
statements, or none.  A family is reported if its calibrated probability reaches ``CONFIDENT`` and
the comparison with the family's templates confirms it: at least ``SIMILAR`` of the word trigrams
of the shorter one are shared.  Otherwise the paragraph is ``unknown`` if the licence classes
together have a probability of one half.

Every line of every text is scored; then lines that follow each other without an end of sentence,
as hard-wrapped texts do, become one paragraph and are scored again as a whole, if one of them is
a licence statement and the others have at least the probability ``WEAK``.  Two confirmed lines of
different families are never joined.

Probabilities are calibrated by a temperature fitted on what models have not seen: templates that
were left out whole, families that were left out whole (right is ``unknown``), and ordinary lines.
Templates are the public texts of licences and their names in ordinary statements; examples of
ordinary text are at most ``MAX_PLAIN_LINES`` lines of at most ``MAX_PLAIN_DOCUMENTS`` documents,
those of the smallest hashes; lines that a first model takes for licences are no examples.

Scoring runs on the JVM, within each row: a line's n-grams are hashed, those that the model knows
are looked up in a constant of the plan, and their weights are added.  Nothing but the lines that
may belong to a licence paragraph is shuffled or written.  Weights and templates are constants of
the model, whose sizes do not depend on the corpus.

Defined results: one row per licence paragraph with its first line and number of lines; null and
empty texts have none; repeated rows are reported each; line numbers start at 0; of equally
probable families the first counts; very long texts are scanned whole; an empty table gives no
rows; extra columns pass only if kept, where a name of an output column is an error.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from codelore.llm.common import hash_pool, materialise, table

#: ``WEAK`` is the probability from which a line may belong to the licence lines beside it.
CONFIDENT, SIMILAR, LICENCE, WEAK = 0.6, 0.6, 0.5, 0.2
MAX_PLAIN_DOCUMENTS, MAX_PLAIN_LINES = 400, 2000
UNKNOWN, NONE = "unknown", "none"

#: Names of each family, its identifier first.
NAMES = {
    "Apache-2.0": ["Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License 2.0"],
    "MIT": ["MIT", "MIT License", "MIT/X11 license", "Expat license"],
    "GPL-3.0": ["GPL-3.0", "GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3"],
    "GPL-2.0": ["GPL-2.0", "GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2"],
    "LGPL-3.0": ["LGPL-3.0", "GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPLv3"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "CC-BY-4.0": ["CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}
#: Names of licences outside the families.
OTHER_NAMES = [
    "ISC License", "zlib License", "Boost Software License 1.0", "Artistic License 2.0", "Eclipse Public License, version 2.0", "European Union Public Licence 1.2",
    "GNU Affero General Public License, version 3", "GNU Free Documentation License, version 1.3", "Creative Commons Zero 1.0", "CC0 1.0", "CC BY 2.5", "CC BY-ND 3.0", "CC BY-SA 2.0",
    "Unlicense", "Python Software Foundation License", "Example Public License, version 1", "Open Data Commons Open Database License", "proprietary license agreement",
]
STATEMENTS = [
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "Released under {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "This software is licensed under the {}.",
    "This program is distributed under the terms of the {}.",
    "The source code is made available under the {}, see the LICENSE file.",
    "License: {}",
    "SPDX-License-Identifier: {}",
]
#: Grants, notices and conditions as the licences state them.
TEXTS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following two conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
#: Licence statements outside the families.
OTHER_TEXTS = [
    "All rights reserved.",
    "Copyright by the authors, all rights reserved.",
    "This document is licensed under a proprietary license agreement.",
    "Use is subject to license terms.",
    "See the license file for licensing terms.",
    "No license is granted to copy or redistribute this work.",
    "Copyright holders grant no permission to redistribute.",
    "This work is dedicated to the public domain.",
    "This file is dual licensed.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "This software is provided 'as-is', without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    "You are free to share and adapt the material as long as you follow the license terms.",
]
_OPENERS = ("", "", "", "Note: ", "This project: ", "The text below is ", "Code and data are ", "Contents of this page are ")
#: Ordinary words that licences use as well, and a word that is a name elsewhere.
_ORDINARY = ("the of this is under in a and or to work use you file version public free general source code any copy terms mit der die das und".split(),)
_SPLIT = re.compile("[^a-z0-9]+")
#: The end of a sentence at the end of a line.
_ENDS = r"""[.!?:;]["')\]]*\s*$"""


def families() -> list[str]:
    return list(NAMES)


def templates() -> dict[str, list[str]]:
    """The texts of every family: its names in statements, and what the licence itself states."""
    return {f: [s.format(n) for n in names for s in STATEMENTS] + [n for n in names if len(words_of(n)) > 2] + TEXTS.get(f, []) for f, names in NAMES.items()}


def others() -> list[str]:
    return [s.format(n) for n in OTHER_NAMES for s in STATEMENTS] + OTHER_TEXTS


def words_of(text: str) -> list[str]:
    return _SPLIT.split(text.lower())


def _hash(*words: str) -> int:
    """The engine's xxhash64 of string arguments."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return h - (h >> 63 << 64)


def ngrams(words: list[str]) -> set[tuple[str, ...]]:
    return {(w,) for w in words if w} | {p for p in zip(words, words[1:], strict=False) if all(p)}


def trigrams(words: list[str]) -> list[int]:
    kept = [w for w in words if w]
    n = max(1, len(kept) - 2)
    return sorted({_hash(*kept[i : i + 3]) for i in range(n)}) if kept else []


def _variants(text: str, rng: random.Random, count: int) -> list[str]:
    """Copies of a template with openers, dropped words and text around; lines of long ones."""
    out = [text]
    words = text.split()
    if len(words) > 20:
        at = 0
        while at < len(words):  # as if hard-wrapped
            step = rng.randint(8, 14)
            out.append(" ".join(words[at : at + step]))
            at += step
    for _ in range(count):
        some = list(words)
        if len(some) > 5:
            for _ in range(rng.randint(0, 2)):
                del some[rng.randrange(len(some))]
        if rng.random() < 0.3:
            some += ["lorem", "dolor"][: rng.randint(1, 2)]
        out.append(rng.choice(_OPENERS) + " ".join(some))
    return out


class _Features:
    """Presence of n-grams in examples, sparse, with a constant column at the end."""

    def __init__(self, texts: list[str], index: dict[tuple[str, ...], int]):
        self.width = len(index) + 1
        rows = [sorted(index[g] for g in ngrams(words_of(t)) if g in index) + [len(index)] for t in texts]
        self.columns = np.array([c for r in rows for c in r], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype(np.int64) if rows else np.zeros(0, np.int64)
        row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        order = np.argsort(self.columns, kind="stable")
        self.by_column = row_of[order]
        self.present, self.column_starts = np.unique(self.columns[order], return_index=True)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.columns], self.starts) if len(self.starts) else np.zeros((0, weights.shape[1]))

    def dot_transposed(self, slopes: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, slopes.shape[1]))
        if len(self.present):
            out[self.present] = np.add.reduceat(slopes[self.by_column], self.column_starts)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _train(x: _Features, y: np.ndarray, classes: int, steps: int = 200, rate: float = 4.0, penalty: float = 3e-5) -> np.ndarray:
    """Proximal gradient descent on cross-entropy; L1 on all but the constant.

    Classes weigh the same, but none four times as much, as most lines are ordinary.
    """
    w = np.zeros((x.width, classes))
    share = 1 / np.maximum(np.bincount(y, minlength=classes), 1)
    share[-1] *= 4
    share = share[y]
    share = (share / share.sum())[:, None]
    target = np.eye(classes)[y]
    for _ in range(steps):
        w -= rate * x.dot_transposed(share * (_softmax(x.dot(w)) - target))
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * penalty, 0)
    return w


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least mean cross-entropy, every class counting the same."""
    share = (1 / np.maximum(np.bincount(y), 1))[y]

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float((share * (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y])).sum())

    return min(np.linspace(0.3, 4, 75).tolist(), key=loss)


class Model:
    """Classes, sparse n-gram weights, intercepts, the calibration temperature, and templates."""

    def __init__(self, plain: list[str], seed: int = 3, folds: int = 2):
        rng = random.Random(seed)
        self.templates = templates()
        self.classes = [*self.templates, UNKNOWN, NONE]
        unknown, none = len(self.templates), len(self.templates) + 1
        # (text, class, number of its template within the class)
        count = lambda t: 10 if t in OTHER_TEXTS else 2
        examples = [(v, k, i) for k, ts in enumerate(self.templates.values()) for i, t in enumerate(ts) for v in _variants(t, rng, count(t))]
        examples += [(v, unknown, i) for i, t in enumerate(others()) for v in _variants(t, rng, count(t))]
        index = {g: i for i, g in enumerate(sorted({g for t, *_ in examples for g in ngrams(words_of(t))}))}
        # Lines of the corpus that a model which has not seen them takes for licences are no examples
        # of ordinary text.
        halves = [[t for t in plain[h::2] if t.strip()] for h in (0, 1)]
        made = [(" ".join(rng.sample(ws, min(len(ws), rng.randint(2, 9)))), none, i) for ws in _ORDINARY for i in range(300)]
        ordinary = list(made)
        for mine, other in (halves, halves[::-1]):
            seen = examples + made + [(t, none, i) for i, t in enumerate(other)]
            w = _train(_Features([t for t, *_ in seen], index), np.array([k for _, k, _ in seen]), none + 1)
            p = _softmax(_Features(mine, index).dot(w))[:, -1] if mine else np.zeros(0)
            ordinary += [(t, none, i) for i, t in enumerate(mine) if p[i] > 0.5]
        examples += ordinary
        rng.shuffle(examples)
        x, y = _Features([t for t, *_ in examples], index), np.array([k for _, k, _ in examples])
        self.temperature = self._calibrated(examples, index, folds)
        weights = _train(x, y, none + 1)
        some = np.abs(weights[:-1]).max(axis=1) > 1e-2
        self.features = [g for g, s in zip(index, some.tolist(), strict=True) if s]
        # As the plan states them.
        self.weights, self.bias = weights[:-1][some].round(4), weights[-1].round(4)

    def _calibrated(self, examples: list[tuple[str, int, int]], index: dict, folds: int) -> float:
        unknown, scores, right = len(self.templates), [], []

        def held_out(out: list[bool], label) -> None:
            seen = [e for e, o in zip(examples, out, strict=True) if not o]
            new = [e for e, o in zip(examples, out, strict=True) if o]
            w = _train(_Features([t for t, *_ in seen], index), np.array([k for _, k, _ in seen]), unknown + 2)
            scores.append(_Features([t for t, *_ in new], index).dot(w))
            right.extend(label(k) for _, k, _ in new)

        for f in range(folds):
            held_out([i % folds == f for _, _, i in examples], lambda k: k)
            held_out([k < unknown and k % folds == f for _, k, _ in examples], lambda k: unknown)
        return _temperature(np.concatenate(scores), np.array(right))

    def probabilities(self, text: str) -> np.ndarray:
        """Of the classes, for one paragraph."""
        at = {g: i for i, g in enumerate(self.features)}
        z = (self.bias + sum((self.weights[at[g]] for g in ngrams(words_of(text)) if g in at), np.zeros(len(self.classes)))) / self.temperature
        return _softmax(z[None])[0]


def _constant(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that is part of the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_PLAIN_DOCUMENTS, lines: int = MAX_PLAIN_LINES) -> Model:
    """A model whose ordinary lines come from the documents of the smallest hashes."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = hash_pool(rows.select("id"), "id", most).orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(most).distinct()
    held = rows.join(F.broadcast(chosen), "id", "left_semi").select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").distinct()
    # A line that is far longer than a paragraph is shortened: examples only, scans read whole texts.
    sample = held.orderBy(F.xxhash64("line", F.lit("sample")), "line").limit(lines).select(F.substring("line", 1, 4000))
    return Model([line for (line,) in sample.toLocalIterator()])


#: Buckets of the constant that holds the weights.
_BUCKETS = 128


def _let(value, use):
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shares(paragraph: str, model: Model):
    """The probabilities of the model's classes for a paragraph, as an array."""
    hashes = [_hash(*g) for g in model.features]
    bias = F.array(*[F.lit(float(b)) for b in model.bias])
    held: list[list[dict]] = [[] for _ in range(_BUCKETS)]
    for h, w in zip(hashes, model.weights.tolist(), strict=True):
        held[h % _BUCKETS].append({"h": h, "w": w})
    constant = F.from_json(F.lit(json.dumps(held)), "array<array<struct<h:bigint,w:array<double>>>>")

    def weights(h):
        return F.get(F.filter(F.get(constant, F.pmod(h, F.lit(_BUCKETS)).cast("int")), lambda e: e["h"] == h), F.lit(0))["w"]

    def known(words):
        """Hashes of the paragraph's n-grams that the model has."""
        of = lambda grams: F.filter(grams, lambda h: h.isin(hashes) if hashes else F.lit(False))
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.array_distinct(F.concat(of(F.transform(words, lambda w: F.xxhash64(w))), of(F.slice(pairs, F.lit(1), F.size(words) - 1))))

    def shares(scores):
        # Scores are bounded by the weights, so their exponentials need no shift.
        risen = F.transform(scores, lambda z: F.exp(z / F.lit(float(model.temperature))))
        return _let(risen, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))

    words = F.split(F.lower(paragraph), "[^a-z0-9]+")
    return _let(words, lambda ws: F.aggregate(known(ws), bias, lambda a, h: F.zip_with(a, weights(h), lambda x, y: x + y), shares))


def _judged(units: DataFrame, model: Model) -> DataFrame:
    """``units`` (with ``paragraph`` and its ``_p``) with ``family``, ``probability``,
    ``similarity``, ``licence`` (the probability of all licence classes) and ``confirmed``.
    """
    of_families = F.slice("_p", 1, len(model.templates))
    best = F.array_max(of_families)
    named = units.withColumn("_best", F.element_at(F.array(*[F.lit(c) for c in model.templates]), F.array_position(of_families, best).cast("int"))).withColumn("_best_p", best)
    held = _constant(units.sparkSession, [{"_best": f, "grams": g} for f, ts in model.templates.items() for g in sorted({tuple(trigrams(words_of(t))) for t in ts})], "_best:string,grams:array<bigint>")
    held = held.groupBy("_best").agg(F.collect_list("grams").alias("_templates"))
    kept = F.filter(F.split(F.lower("paragraph"), "[^a-z0-9]+"), lambda w: w != "")
    compared = named.withColumn("_kept", kept).withColumn(
        "_trigrams",
        F.when(F.size("_kept") == 0, F.expr("cast(array() as array<bigint>)"))
        .when(F.size("_kept") == 1, F.array(F.xxhash64(F.get("_kept", F.lit(0)))))
        .when(F.size("_kept") == 2, F.array(F.xxhash64(F.get("_kept", F.lit(0)), F.get("_kept", F.lit(1)))))
        .otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_kept") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("_kept", i), F.get("_kept", i + 1), F.get("_kept", i + 2))))),
    ).join(F.broadcast(held), "_best")
    shared = F.transform("_templates", lambda t: F.size(F.array_intersect("_trigrams", t)) / F.greatest(F.least(F.size("_trigrams"), F.size(t)), F.lit(1)))
    shown = compared.withColumn("similarity", F.array_max(shared)).withColumn("licence", F.lit(1.0) - F.element_at("_p", -1))
    confirmed = (F.col("_best_p") >= CONFIDENT) & (F.col("similarity") >= SIMILAR)
    return (
        shown.withColumn("confirmed", confirmed)
        .withColumn("family", F.when(confirmed, F.col("_best")).otherwise(F.lit(UNKNOWN)))
        .withColumn("probability", F.when(confirmed, F.col("_best_p")).otherwise(F.col("licence")))
        .select(*[c for c in units.columns if c != "_p"], "family", "probability", "similarity", "licence", "confirmed")
    )


def scan(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """A row per licence paragraph: ``keep`` columns, ``line``, ``n_lines``, ``family``,
    ``probability``, ``similarity`` to the family's nearest template, and the ``paragraph``.
    """
    if taken := {"line", "n_lines", "family", "probability", "similarity", "paragraph"} & {c.lower() for c in keep}:
        raise ValueError(f"output columns among those to keep: {sorted(taken)}")
    row = "_row"
    # Rows are numbered before their lines are taken apart.
    rows = docs.select(F.monotonically_increasing_id().alias(row), F.struct(*keep).alias("_keep"), F.col(text_col).cast("string").alias("_text"))
    lines = rows.select(row, "_keep", F.posexplode(F.split("_text", "\n")).alias("line", "paragraph"))
    # A confirmed family has more than ``WEAK`` as well.
    candidates = materialise(lines.withColumn("_p", _shares("paragraph", model)).where(F.element_at("_p", -1) <= 1 - WEAK))
    licences = materialise(_judged(candidates, model))
    # Adjacent licence lines without an end of sentence between them are one paragraph.
    order = W.partitionBy(row).orderBy("line")
    before = lambda c: F.lag(c).over(order)
    apart = before("line").isNull() | (F.col("line") - before("line") > 1) | before("paragraph").rlike(_ENDS) | (F.col("confirmed") & before("confirmed") & (F.col("family") != before("family")))
    own = F.struct("line", "paragraph", "family", "probability", "similarity")
    runs = licences.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(order)).groupBy(row, "_run").agg(F.first("_keep").alias("_keep"), F.sort_array(F.collect_list(own)).alias("_lines"), F.max(F.col("confirmed") | (F.col("licence") >= LICENCE)).alias("_sure")).where("_sure")
    single = runs.where(F.size("_lines") == 1).select("_keep", F.lit(1).alias("n_lines"), F.col("_lines")[0].alias("x")).select("_keep", "n_lines", "x.*")
    joined = materialise(runs.where(F.size("_lines") > 1).select(row, "_run", "_keep", F.col("_lines")[0]["line"].alias("line"), F.size("_lines").alias("n_lines"), F.array_join(F.col("_lines.paragraph"), "\n").alias("paragraph")))
    again = _judged(joined.withColumn("_p", _shares("paragraph", model)), model)
    columns = ["_keep", "line", "n_lines", "family", "probability", "similarity", "paragraph"]
    every = single.select(*columns).unionByName(again.select(*columns))
    return every.select("_keep.*", "line", "n_lines", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "paragraph")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES: dict[str, str] = {}
