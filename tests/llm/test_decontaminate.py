import hashlib
import random
import re

import pytest

from codelore.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is None or not w:
            continue
        n = min(8, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in range(1, 9):
            for i in range(len(w) - n + 1):
                if who := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= who
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(found) >= 2))
    return out


def tables(spark, vocabulary=6, seed=1):
    rng = random.Random(seed)
    pool = [f"W{i}" for i in range(vocabulary)] + ["é", "x-y"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([8, 9, 12, 20])))) for i in range(12)]
    items += [(100, "Rare short, item"), (101, "one"), (102, ""), (103, None), (None, items[0][1]), (104, items[0][1]), (104, "zz yy")]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for i in range(60)]
    docs += [(200 + i, "before! " + t + " (after) ONE") for i, (_, t) in enumerate(items) if t]
    docs += [(300, None), (301, ""), (302, "--"), (None, items[3][1]), (303, "rare SHORT item"), (303, "rare SHORT item"), (304, (items[1][1] + " q ") * 50)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def as_query(found):
    F = D.F
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    rows = found.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(names, 256), D.contaminated()).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("most", [10**6, 30])
def test_equals_brute_force(spark, most):
    for seed in (1, 2):
        docs, items, d, b = tables(spark, seed=seed)
        assert as_query(D.find_matches(d, b, max_test_words=most)) == sorted(brute(docs, items), key=str)


def brute_longest(docs, items):
    """The longest common run of words of every document and any item, and its first place."""
    tests = [words(t) for i, t in items if i is not None and words(t)]
    out = []
    for doc, text in docs:
        w, best = words(text), (0, None)
        for t in tests:
            for i in range(len(w)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(w) and j + n < len(t) and w[i + n] == t[j + n]:
                        n += 1
                    if (n >= 2 or n == len(t) == 1) and (n, -i) > (best[0], -(best[1] or 0)):
                        best = (n, i)
        out.append((str(doc), *best))
    return sorted(out, key=str)


@pytest.mark.parametrize("most,vocabulary", [(10**6, 6), (10**6, 60), (40, 25)])
def test_longest_matches_equal_brute_force(spark, most, vocabulary):
    docs, items, d, b = tables(spark, vocabulary=vocabulary, seed=vocabulary)
    rows = D.find_matches(d, b, max_test_words=most).collect()
    assert sorted(((str(r.doc_id), r.longest, r.longest_at) for r in rows), key=str) == brute_longest(docs, items)
    texts, held = dict((str(i), words(t)) for i, t in docs), {}
    for i, t in items:
        held.setdefault(i, []).append(" ".join(words(t)))
    for r in rows:
        if r.longest:
            run = " ".join(texts[str(r.doc_id)][r.longest_at : r.longest_at + r.longest])
            assert any(f" {run} " in f" {t} " for t in held[r.longest_item])


def test_suffixes_are_in_order_as_deep_as_tests_reach():
    item = " ".join(f"k{i % 3}" for i in range(60))
    test = D.TestSuffixes(D.TestBlock([1], [item.encode()]), 8)
    shard = D.Shard([(item + " zz " + item[:70]).encode(), item.encode(), None, b"k1 k2"], test)
    def deep(p):
        out = shard.words[p : p + 60].tolist()
        return out[: out.index(0) + 1] if 0 in out else out
    found = [deep(p) for p in shard.suffixes.tolist()]
    assert found == sorted(found) and len(found) > 100


def test_longest_match_and_location(spark):
    item = " ".join(f"k{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b " + " ".join(f"k{i}" for i in range(5, 25)) + " c"), (2, item)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    rows = {r.doc_id: r for r in D.find_matches(docs, bench).collect()}
    assert (rows[1].longest, rows[1].longest_item, rows[1].longest_at) == (20, "q", 2)
    assert [tuple(h) for h in rows[1].hits] == [(2, 22)]
    assert (rows[2].longest, rows[2].n_hit) == (30, 30)


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    docs, items, d, b = tables(spark, vocabulary=200)
    d = d.withColumn("items", D.F.lit("mine")).withColumn("n_words", D.F.lit(1))
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in brute(docs, items) if not x[-1])


def test_empty_tables(spark):
    _, _, d, b = tables(spark)
    assert D.find_matches(d.where("false"), b).collect() == []
    for name in ("items", "N_Hit"):
        with pytest.raises(ValueError):
            D.find_matches(d.withColumn(name, d.doc_id), b, keep=("doc_id", name))
    none = D.find_matches(d, b.where("false")).collect()
    assert len(none) == d.count() and all(r.n_hit == 0 and list(r["items"]) == [] for r in none)
