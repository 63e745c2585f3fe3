import random

import numpy as np
import pytest
import xxhash

from codelore.llm import simhash as S


def brute_components(fps, ids):
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                parent[find(a)] = find(b)
    least = {}
    for f, d in zip(fps, ids, strict=True):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [least.get(find(f)) for f in fps]


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def clustered(rng, centres, members, flips):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            f = c
            for _ in range(rng.randint(0, flips)):
                f ^= 1 << rng.randrange(64)
            out.append(f)
    return out


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    words = ["A", "b", "Çé", "ÀB", "x\x0by", "the", "\x1c", "dog", "İ"]
    for n in range(60):
        text = rng.choice([" ", "\n\t", "  "]).join(rng.choices(words, k=n % 12))
        assert S.fingerprint(text.encode()) == brute_fingerprint(text), text
    long = " ".join(rng.choices(words, k=70_000))
    assert S.fingerprint(long.encode()) == brute_fingerprint(long)
    assert S.fingerprint(None) == S.fingerprint(b"") == S.fingerprint(b" \n") == 0


@pytest.mark.parametrize("block", [8, 2048])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(2)
    fps = [x - (x >> 63 << 64) for x in set(clustered(rng, 30, 4, 3) + clustered(rng, 1, 120, 5) + clustered(rng, 20, 3, 8))]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = S.links(df, block)
    pairs = [(r.u, r.v) for r in edges.collect()]
    assert all(bin((u ^ v) & (2**64 - 1)).count("1") <= 3 for u, v in pairs)
    got = {r.node: r.root for r in S.components(edges).collect()}
    ids = list(range(len(fps)))
    expected = brute_components([f & (2**64 - 1) for f in fps], ids)
    same = {}
    for f, e in zip(fps, expected, strict=True):
        same.setdefault(got.get(f, f), set()).add(e)
    assert all(len(v) == 1 for v in same.values())
    assert len(same) == len(set(expected))


def test_chain_becomes_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert S.components(edges.where("false")).collect() == []


def texts():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(50 + i, t) for i, t in enumerate(base[:5])]
    rows += [(80 + i, t + f" tail{i}") for i, t in enumerate(base)]
    return rows + [(70, None), (71, ""), (72, " \n"), (None, base[0]), (3, base[3]), (90, "one two")]


def test_query_on_documents(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", S.F.lit("clash"))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.near_duplicates(df).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components(fps, [d for d, _ in rows])
    assert got == sorted((str(d), f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, comps, strict=True))


def test_keep_one(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    comps = {c for c in brute_components([brute_fingerprint(t) for _, t in rows], [d for d, _ in rows])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(comps)
    assert S.keep_one(df.where("false")).collect() == []
    only_null = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert S.keep_one(only_null).count() == 1


def test_group_forest_spans_without_all_pairs():
    fps = np.array([0, 1, 3, 7, 15, 255], dtype=np.int64)
    edges = S.group_forest(fps, np.zeros(6, int), np.zeros(6, int))
    assert len(edges) == 4
