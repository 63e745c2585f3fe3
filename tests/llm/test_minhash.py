import random

import pytest

from codelore.llm import minhash as M
from tests.llm import test_simhash


def brute_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(docs):
    """Ids that stay: the smallest of each component of pairs at 0.8."""
    sets = [brute_sets(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(2000)]
    texts = [rng.choices(words, k=rng.randint(60, 300)) for _ in range(60)]
    for t in texts[:40]:
        for changed in (1, 2, 4, 6):
            copy = list(t)
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = rng.choice(words)
            texts.append(copy)
    texts += [["short", "text"], ["short", "text"], ["short"], texts[0], texts[0] * 3]
    docs = [" ".join(t) for t in texts] + [None, "", " \n"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [M.BLOCK, 2])
def test_one_of_each_group_at_the_similarity_stays(spark, block):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, node string")
    out = M.keep_one(df, block=block)
    assert out.columns == df.columns
    expected = brute_kept(docs)
    assert sorted(r.doc_id for r in out.collect()) == expected and len(expected) < len(docs) - 80


def test_pipeline_stage_removes_copies_at_the_similarity(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(104)]
    near, far = list(words), list(words)
    near[30] = near[70] = "other"
    for i in (10, 30, 50, 70, 90):
        far[i] = "other"
    docs = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (None, "alone"), (4, "again"), (4, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = dict(pipeline.STAGES)["simhash"](spark, df, "")
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "3", "4", "None"]
    assert dict(pipeline.STAGES)["simhash"](spark, df.where("false"), "").collect() == []


def brute_kept_by_both(docs, bits=3, least=0.8):
    """Ids that stay: the smallest of each component of pairs within the bits or at the similarity."""
    sets = [brute_sets(t) for _, t in docs]
    fps = [test_simhash.brute_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if bin(fps[i] ^ fps[j]).count("1") <= bits or a == b or len(a & b) >= least * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def test_pipeline_stage_links_by_fingerprints_and_by_similarity(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(2000)]
    texts = [rng.choices(words, k=200) for _ in range(40)]
    for t in list(texts):
        for changed in (3, 6, 6, 6, 6):
            copy = list(t)
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = rng.choice(words)
            texts.append(copy)
    # Of one fingerprint, as one line prevails, but of few shared shingles.
    line = rng.choices(words, k=7)
    texts += [line * 200 + rng.choices(words, k=30) for _ in range(4)]
    docs = [" ".join(t) for t in texts] + [None, "", " \n", "one"]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r.doc_id for r in dict(pipeline.STAGES)["simhash"](spark, df, "").collect())
    both, similar, near = brute_kept_by_both(docs), brute_kept_by_both(docs, bits=-1), brute_kept_by_both(docs, least=2)
    assert kept == both
    # Each kind of links finds what the other one does not, beyond the line's texts.
    assert len(both) < len(similar) - 3 and len(both) < len(near)
