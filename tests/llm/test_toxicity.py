import os
import random
import subprocess
import sys

import numpy as np

from codelore.llm import toxicity as X


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdeginorst", k=rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 90))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilezz", "vilezza", "vilezzo", "crudx"]))
        low = i % 5 == 0
        if low:
            words = words[:4] * 12 + words
        rows.append((i, " ".join(words), int(not low), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 280], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.score(docs, X.fit(docs, labels)).collect()}
    new = [r for r in rows if r[0] >= 280]
    assert sum(got[i].toxic == bool(x) for i, _, _, x in new) >= 0.95 * len(new)
    assert sum(got[i].low_quality == (not q) for i, _, q, _ in new) >= 0.9 * len(new)
    kept = X.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.toxic}


def test_later_links_see_earlier_probabilities():
    rng = np.random.default_rng(0)
    texts = [f"w{i} " + ("alpha beta" if i % 2 else "gamma delta") for i in range(120)]
    first = [bool(i % 2) for i in range(120)]
    second = [x and rng.random() < 0.95 for x in first]
    chain = X.fit_chain(texts, {"a": first, "b": second})
    assert [len(link.earlier) for link in chain] == [0, 1]
    assert chain[1].earlier[0] > 0
    found = X.features(texts[1])
    assert chain[1].probability(found, [1.0]) > chain[1].probability(found, [0.0])


def test_threshold():
    assert X.best_threshold(np.array([0.1, 0.2, 0.8, 0.9]), np.array([False, False, True, True])) == 0.5
    assert X.best_threshold(np.array([0.1]), np.array([False])) == 0.5


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "some text", None)], "doc_id long, text string, toxic string")
    one_kind = spark.createDataFrame([(2, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (one_kind, one_kind.where("false")):
        rows = X.score(docs, X.fit(docs, labels)).collect()
        assert len(rows) == 4 and not any(r.toxic for r in rows)
        assert X.reject_toxic(docs, labels).columns == ["doc_id", "text", "toxic"]
        assert X.reject_toxic(docs, labels).count() == 4
    assert X.score(docs.where("false"), X.fit(docs, one_kind)).collect() == []


def test_long_text_counts_whole():
    texts = [f"t{i} " + "plain words only " * (i % 3 + 1) + ("vilezz" if i % 2 else "") for i in range(80)]
    chain = X.fit_chain(texts, {"toxic": [bool(i % 2) for i in range(80)]})
    assert X.chain_probabilities(chain, "plain words only " * 50_000 + "vilezz")[0] >= chain[0].threshold
    assert X.chain_probabilities(chain, "plain words only " * 50_000)[0] < chain[0].threshold


def dense_fit(x, shape, y, use, steps=200, decay=3e-4):
    """The linear model on a dense matrix with named steps, as the method states it."""
    n, pos, neg = len(y), y[use].sum(), (~y[use]).sum()
    a, b = x[use & y].sum(0), x[use & ~y].sum(0)
    odds = np.log((a + 0.5) / (pos - a + 0.5)) - np.log((b + 0.5) / (neg - b + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (pos - a + 0.5) + 1 / (b + 0.5) + 1 / (neg - b + 0.5))
    z[a + b < X.LEAST_DOCUMENTS] = 0
    cols = np.flatnonzero(z >= X.LEAST_Z)
    share = np.where(y, min(10.0, neg / pos), 1.0) * use
    share = share / share.sum()
    full = np.concatenate([x[:, cols], shape, np.ones((n, 1))], axis=1)
    w = np.zeros(full.shape[1])
    penalty = np.full(len(w), decay)
    penalty[-1] = 0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        g = full.T @ (share * (p - y)) + penalty * w
        m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
        w = w - 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))


def test_chain_equals_brute_force():
    rows = corpus(150, seed=9)
    random.Random(3).shuffle(rows)  # every fold has every label
    texts = [t for _, t, _, _ in rows]
    assert X._without_near_copies(texts) == list(range(len(texts)))
    found = [X.features(t) for t in texts]
    names = sorted({("w", w) for f in found for w in f[0]} | {("b", b) for f in found for b in f[1]})
    counts = {k: sum((k[1] in f[0]) if k[0] == "w" else (k[1] in f[1]) for f in found) for k in names}
    names = [k for k in names if counts[k] >= X.LEAST_DOCUMENTS]
    x = np.array([[(k[1] in f[0]) if k[0] == "w" else (k[1] in f[1]) for k in names] for f in found], dtype=float)
    shape = np.array([f[2] for f in found])
    labels = {"low_quality": np.array([not q for _, _, q, _ in rows]), "toxic": np.array([bool(t) for *_, t in rows])}
    chain = X.fit_chain(texts, {k: v.tolist() for k, v in labels.items()})
    fold, every = np.arange(len(texts)) % X.FOLDS, np.ones(len(texts), dtype=bool)
    train = shape
    for k, (name, y) in enumerate(labels.items()):
        out_of_fold = np.zeros(len(y))
        for f in range(X.FOLDS):
            out_of_fold[fold == f] = dense_fit(x, train, y, fold != f)[fold == f]
        assert abs(chain[k].threshold - X.best_threshold(out_of_fold, y)) < 1e-6
        if k == 0:  # the first link has no earlier one: its training inputs are those of prediction
            expected = dense_fit(x, train, y, every)
            got = [X.chain_probabilities(chain, t)[0] for t in texts]
            assert np.allclose(got, expected, atol=1e-6)
        else:  # trained with out-of-fold probabilities, applied with those of the fitted links
            on_training = dense_fit(x, train, y, every)
            got = [chain[k].probability(f, [float(p)]) for f, p in zip(found, train[:, -1], strict=True)]
            assert np.allclose(got, on_training, atol=1e-6)
        train = np.concatenate([train, out_of_fold[:, None]], axis=1)


def test_the_same_in_every_process():
    code = "from tests.llm.test_toxicity import corpus, X\nrows = corpus(120)\nc = X.fit_chain([t for _, t, _, _ in rows], {'q': [not q for _, _, q, _ in rows], 't': [bool(t) for *_, t in rows]})\nprint([(x.threshold, x.intercept, sorted(x.words.items())[:50]) for x in c], [X.chain_probabilities(c, t) for _, t, _, _ in rows[:20]])"
    out = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": seed, "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout for seed in "123"}
    assert len(out) == 1
