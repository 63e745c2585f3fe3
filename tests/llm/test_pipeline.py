import random

import pytest

from tests.llm import test_decontaminate, test_pii, test_simhash

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted toxic texts, copies, benchmark passages and personal data."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeginorst", k=rng.randint(3, 8))) for _ in range(800)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, say(20)) for i in range(6)]
    docs, labels = [], []
    for i in range(300):
        text = say(rng.randint(30, 120))
        if i % 6 == 0:
            text = f"vilezz crudx {text} vilezz"
        if i % 10 == 1:
            text += f" {items[0][1]} and {items[1][1]}"
        if i % 10 == 2:
            text += " mail me@corp.example.com"
        docs.append((i, text, "en", "s", len(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 6 == 0)))
    docs += [(1000 + i, docs[3 + i][1], "en", "s", 1) for i in range(20)]
    docs += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (None, say(40), "en", "s", 1), (3, docs[3][1], "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_every_stage_against_brute_force(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stage = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "byte_bpe"]

    kept = stage["toxicity"](spark, docs, path).cache()
    toxic = {d for d, t in rows(docs) if t and "vilezz" in t}
    assert kept.columns == columns
    gone = sorted(map(str, {d for d, _ in rows(docs)} - {d for d, _ in rows(kept)}))
    assert gone == sorted(map(str, toxic))

    one = stage["simhash"](spark, kept, path).cache()
    before = rows(kept)
    comps = test_simhash.brute_components([test_simhash.brute_fingerprint(t) for _, t in before], [d for d, _ in before])
    assert one.columns == columns
    assert sorted(map(str, (d for d, _ in rows(one)))) == sorted(map(str, set(comps)))

    clean = stage["decontamination"](spark, one, path).cache()
    bad = {d for d, *_, hit in test_decontaminate.brute(rows(one), items) if hit}
    assert clean.columns == columns
    assert sorted(map(str, (d for d, _ in rows(clean)))) == sorted(map(str, {d for d, _ in rows(one)} - bad)) and bad

    safe = stage["pii"](spark, clean, path).cache()
    assert safe.columns == columns and safe.count() == clean.count()
    assert not any(test_pii.brute(t) for _, t in rows(safe))
    texts = dict(rows(clean))
    assert all(t == texts[d] for d, t in rows(safe) if "@" not in (texts[d] or ""))

    done = stage["byte_bpe"](spark, safe, path)
    assert sorted(map(str, rows(done))) == sorted(str((d, t or "")) for d, t in rows(safe))


def test_run_applies_the_stages(spark, folder):
    path, _ = folder
    out = pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids", "text"] and 200 < out.count() < 290


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_one_benchmark_item_is_removed(spark, tmp_path):
    items = [(k, " ".join(f"i{k}w{n}" for n in range(20))) for k in range(2)]
    first = items[0][1].split()
    texts = ["plain words", f"before {items[0][1]} after", f"a {' '.join(first[5:13])} b", f"a {' '.join(first[5:12])} b", f"{items[0][1]} {items[1][1]}", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = dict(pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6]
