import re
import textwrap

import numpy as np
import pytest

from codelore.llm import licenses as L

FAMILY = {"Apache License": "Apache-2.0", "MIT License": "MIT", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
PLAIN = ["the house of the and in this that", "ordinary prose about nothing", "water runs down the hill to the sea", "rain fell on the roof all night"]
PLAIN += [f"the {a} of {b} was {c}" for a in ("side", "top", "name") for b in ("wood", "stone", "a river") for c in ("old", "new", "green", "in use")]


@pytest.fixture(scope="module")
def model():
    return L.Model(PLAIN)


def judge(model, text):
    """(family, licence probability, confirmed) of one paragraph."""
    p = model.probabilities(text)
    k = int(np.argmax(p[: len(model.templates)]))
    name, grams = list(model.templates)[k], set(L.trigrams(L.words_of(text)))
    near = max(len(grams & set(g)) / max(1, min(len(grams), len(g))) for g in (L.trigrams(L.words_of(t)) for t in model.templates[name]))
    sure = p[k] >= L.CONFIDENT and near >= L.SIMILAR
    return name if sure else L.UNKNOWN, 1 - p[-1], sure


def brute(model, text):
    """The scan's definition: lines, then runs of lines scored again."""
    runs, last = [], None
    for i, line in enumerate(text.split("\n") if text is not None else []):
        family, licence, sure = judge(model, line)
        if licence < L.WEAK:
            continue
        end = last and re.search(L._ENDS, last[1])
        if last is None or i - last[0] > 1 or end or (sure and last[3] and family != last[2]):
            runs.append([])
        last = (i, line, family, sure, sure or licence >= L.LICENCE)
        runs[-1].append(last)
    runs = [r for r in runs if any(x[4] for x in r)]
    return [(r[0][0], len(r), r[0][2] if len(r) == 1 else judge(model, "\n".join(x[1] for x in r))[0]) for r in runs]


def scanned(spark, texts, model):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("line", L.F.lit("clash")).withColumn("_row", L.F.lit("clash"))
    return sorted((r.doc_id, r.line, r.n_lines, r.family) for r in L.scan(df, model).collect())


def test_scan_equals_brute_force(spark, model):
    every = [t for ts in model.templates.values() for t in ts]
    texts = every[::3] + L.others()[::5] + L.OTHER_TEXTS + ["prose\n" + t + "\nMore prose after it\n\nfree version terms" for t in every[::7]]
    texts += ["\n".join(textwrap.wrap(t, 76)) for ts in L.TEXTS.values() for t in ts]
    texts += [None, "", "\n\n", "license", "MIT", "free software of the house", "THE MIT LICENSE", "License: MIT\nLicense: Apache-2.0\nlicense", "x " * 50_000 + "\nReleased under the MIT License.", *PLAIN]
    assert scanned(spark, texts, model) == sorted((d, *x) for d, t in enumerate(texts) for x in brute(model, t))


WRAPPED = {
    "MIT": L.TEXTS["MIT"][0],
    "BSD-3-Clause": L.TEXTS["BSD-3-Clause"][2],
    "Apache-2.0": L.TEXTS["Apache-2.0"][0],
    "GPL-3.0": L.TEXTS["GPL-3.0"][0],
    "MPL-2.0": L.TEXTS["MPL-2.0"][0],
}


@pytest.mark.parametrize("columns", [60, 80])
def test_hard_wrapped_texts_among_prose(spark, model, columns):
    texts = ["the first line of prose.\n\n" + "\n".join(textwrap.wrap(t, columns)) + "\n\nrain fell on the roof" for t in WRAPPED.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = L.scan(df, model).collect()
    for d, (family, text) in enumerate(WRAPPED.items()):
        mine = [r for r in rows if r.doc_id == d]
        covered = sum(len(r.paragraph.split()) for r in mine if r.family == family)
        assert covered >= 0.9 * len(text.split()), (family, [(r.line, r.n_lines, r.family) for r in mine])
        assert {r.family for r in mine} <= {family, L.UNKNOWN}


def test_statements_that_no_template_has(spark, model):
    new = {
        "This code may be used freely under the Apache 2.0 license terms": "Apache-2.0",
        "Distributed under the MIT License, a copy of which is attached": "MIT",
        "You may share these pages under CC BY-NC 4.0": "CC-BY-NC-4.0",
        "All files here are covered by the GNU General Public License, version 3": "GPL-3.0",
        "covered by the Mozilla Public License 2.0": "MPL-2.0",
    }
    assert scanned(spark, list(new), model) == [(i, 0, 1, f) for i, f in enumerate(new.values())]


def test_unknown_licences(spark, model):
    other = ["This file is dual licensed ISC", "Licensed under the Upstream Compatibility License 1.0", "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted.", "Released under CC BY 2.5.", "All rights reserved.", "This is free and unencumbered software released into the public domain."]
    assert scanned(spark, other, model) == [(i, 0, 1, L.UNKNOWN) for i in range(len(other))]
    assert scanned(spark, PLAIN, model) == []


def test_licence_lines_of_the_corpus_are_no_examples_of_ordinary_text(spark):
    grants = ["This is free and unencumbered software released into the public domain.", "Released under the MIT License.", "All rights reserved."]
    model = L.Model(sorted(PLAIN + grants))
    assert [judge(model, t)[1] >= L.LICENCE for t in grants] == [True] * 3


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    lines = [(r.doc_id, i, line) for r in docs for i, line in enumerate(r.text.split("\n"))]
    expected = {(d, i): f for d, i, line in lines for key, f in FAMILY.items() if re.search(f"[Ll]icensed under.*{key}|Released under the {key}", line)}
    expected |= {(d, i): L.UNKNOWN for d, i, line in lines if line == "All rights reserved."}
    found = L.op3_license_scan(spark, "/root/testdata/sf0.01")
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    assert {(r.doc_id, r.line): r.family for r in found.collect()} == expected and expected


def test_repeated_rows_empty_and_clashing_names(spark, model):
    df = spark.createDataFrame([(None, "Released under the MIT License.")] * 2, "doc_id long, text string")
    assert [r.family for r in L.scan(df, model).collect()] == ["MIT", "MIT"]
    assert L.scan(df.where("false"), model).collect() == []
    assert L.fit(df.where("false")) is not None
    for name in ("family", "Line"):
        with pytest.raises(ValueError):
            L.scan(df.withColumn(name, df.doc_id), model, keep=("doc_id", name))
