import zlib

import numpy as np

from codelore.llm import language_id as L


def test_gradients_by_finite_differences():
    net = L.Network(["a", "b", "c"], hidden=3)
    rng = np.random.default_rng(0)
    windows, labels = rng.integers(0, 256, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    for name in ("table", "recurrent", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    _, grads = net.gradients(windows, labels)
    for weight, grad in zip(net.weights, grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        weight[at] += 1e-4
        above = net.gradients(windows, labels)[0]
        weight[at] -= 2e-4
        below = net.gradients(windows, labels)[0]
        weight[at] += 1e-4
        assert abs(grad[at] - (above - below) / 2e-4) < 1e-3 * max(1, abs(grad[at]))


def test_inference_equals_training_forward():
    net = L.Network(["a", "b"], hidden=4)
    windows = np.random.default_rng(1).integers(1, 256, (5, 9)).astype(np.uint8)
    h = np.zeros((2, 4, 5), np.float32)
    ahead = []
    for i in range(9):
        x = np.stack([net.table[0][:, windows[:, i]], net.table[1][:, windows[:, 8 - i]]])
        h = net._step(x, h)[-1]
        ahead.append(h)
    states = net.states(windows)
    assert np.allclose(states[:, 0], np.stack([a[0] for a in ahead]), atol=1e-5)
    assert np.allclose(states[::-1, 1], np.stack([a[1] for a in ahead]), atol=1e-5)
    p = net.position_probabilities(windows)
    assert p.shape == (9, 2, 5) and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_undetermined_unlabelled_and_whole_texts(spark):
    base = [(i, "der die und das ist nicht " * 9 if i % 2 else "the and of with this that " * 9, "de" if i % 2 else "en", "x") for i in range(40)]
    odd = [(100, None, "en", "x"), (101, "", None, "x"), (102, "123 ... 456", "en", "x"), (103, "the and of " * 900 + "der die und das ist nicht " * 9000, None, "x"), (None, "with this that and", None, None)]
    df = spark.createDataFrame(base + odd + odd[:1], "doc_id long, text string, lang string, _text string")
    got = {}
    for r in L.identify(df, L.fit(df)).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert got[100] == [("und", 0.0)] * 2 and got[101][0][0] == got[102][0][0] == "und"
    assert got[103][0][0] == "de" and got[None][0][0] == "en"
    none = df.withColumn("lang", L.F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(none, L.fit(none)).collect()} == {"und"}
    assert L.identify(df.where("false"), L.fit(df.where("false"))).collect() == []


def test_positions_past_the_end_do_not_count():
    net = L.train(["the and of with this that " * 30, "der die und das ist nicht " * 30], ["en", "de"], steps=60)
    (_, one), (_, two) = L.predict(net, ["the and of with this", "the and of with this"])
    assert one == two <= 1


def test_rare_languages_are_sampled_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(L, "train", lambda texts, languages: languages)
    docs = spark.range(60_000).selectExpr("id as doc_id", "'some text' as text", "if(id % 3000 = 7, 'rare', 'often') as lang")
    found = L.fit(docs)
    rare = docs.where("lang = 'rare'").where(~L.held_out("doc_id")).count()
    assert rare > 10 and found.count("rare") == rare and found.count("often") == L.MAX_PER_LANGUAGE


def test_letters_are_category_l(spark):
    texts = ["½ ² ", "Ⅷ", "١٢٣", "́", "_ 12", "ʰ", "漢", "ª"]
    net = L.train(["the and of with this that " * 30, "der die und das ist nicht " * 30], ["en", "de"], steps=5)
    assert [lang == "und" for lang, _ in L.predict(net, texts)] == [True] * 5 + [False] * 3


def test_windows_read_their_neighbours():
    data = bytes(range(1, 256))
    w = L.windows_of(data, span=10, context=4)
    assert w.shape == (26, 18)
    assert w[0].tolist() == [0] * 4 + list(range(1, 15)) and w[3].tolist() == list(range(27, 45))
    assert w[-1].tolist() == [247, 248, 249, 250, 251, 252, 253, 254, 255] + [0] * 9
    piece = L.windows_of(data[50:70], data[:50], data[70:], span=10, context=4)
    assert piece.tolist() == w[5:7].tolist()


def test_languages_beyond_the_bound_are_the_rarest(spark, monkeypatch):
    monkeypatch.setattr(L, "train", lambda texts, languages: sorted(set(languages)))
    docs = spark.range(400).selectExpr("id as doc_id", "'some text' as text", "if(id % 10 = 7, 'rare', if(id % 2 = 0, 'a', 'b')) as lang")
    assert L.fit(docs, languages=2) == ["a", "b"]
