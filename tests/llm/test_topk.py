import random
from fractions import Fraction

import numpy as np
import pytest

from codelore.llm import topk as T
from tests.llm.oracle import assert_same


def brute(rows, k=20, step=20):
    use = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            use.append((i, tuple(int(x // Fraction(1, 64)) for x in map(Fraction, v))))
    out = []
    for q in {i for i, _ in use if i % step == 0}:
        found = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for qv in {v for i, v in use if i == q} for i, v in use if i != q and len(v) == len(qv))
        out += [(q, r + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, kind="float", **more):
    v = T.participants(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
    return sorted(tuple(r) for r in T.top_k(v, v.where("id % 20 = 0"), **more).collect())


@pytest.mark.parametrize("shard", [40, 8192])
def test_equals_brute_force_with_ties_and_odd_vectors(spark, shard):
    rng = random.Random(4)
    single = lambda x: float(np.float32(x))
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0, single(rng.gauss(0, 1))]) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)]  # a very common vector
    rows += [(2000, None), (2020, []), (2040, [1.0, None] * 3), (2060, [float("nan")] * 6), (2080, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (40, rows[40][1]), (3000, [0.0] * 6)]
    assert run(spark, rows, shard=shard, block=7) == brute(rows)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows) == [(0, 1, 1, 64 * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where("false")
    assert T.top_k(T.participants(df), T.participants(df)).collect() == []


def test_walk_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-5, 6, (4000, 3))
    vectors[7] = [60, 60, 60]
    vectors[9] = [60, 59, 60]
    lists = T.Lists(np.arange(4000), vectors.astype(np.int64), 1)
    ids, scores, depth = lists.top(np.array([64, 64, 64]), -1)
    assert ids.tolist() == [7] and depth < 4000
    assert scores.tolist() == [64 * 180]


def test_large_components_are_exact():
    vectors = np.array([[2**30, 1], [2**30, 2], [5, 5]], dtype=np.int64)
    ids, scores, _ = T.Lists(np.arange(3), vectors, 2).top(np.array([2**30, 1]), -1)
    assert ids.tolist() == [1, 0] and scores.tolist() == [2**60 + 2, 2**60 + 1]


def test_repeated_rows_each_count(spark):
    rows = [(0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [1.0]), (0, [1.0]), (20, [2.0]), (20, [-1.0])] + [(7, [3.0])] * 30
    assert run(spark, rows, k=3) == brute(rows, k=3)
    assert run(spark, rows) == brute(rows)
    assert [r[2] for r in run(spark, rows) if r[0] == 0] == [7] * 20
    rows = [(0, [1.0])] * 50 + [(i, [1.0]) for i in range(1, 60)] + [(20, [1.0])] * 50
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_components_of_any_size_take_part(spark, kind):
    rows = [(0, [1e9, 1.0]), (1, [2e9, 0.5]), (2, [1.0, 1.0]), (20, [0.5, 2.0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    if kind == "double":
        rows += [(40, [1e300, -3.0]), (41, [1.7e308, 1.0]), (42, [-1e200, 9.0]), (60, [2.0**57, 2.0**57]), (61, [2.0**60, -(2.0**60)]), (62, [-1e199, 2.0])]
    assert run(spark, rows, kind) == brute(rows)
    assert run(spark, rows, kind, k=2) == brute(rows, k=2)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 5, [9.0], 1), (1, [2.0], 6, None, 2)], "vec_id long, embedding array<float>, id long, v array<float>, dims int")
    assert T.top_k(T.participants(df), T.participants(df).where("id % 20 = 0")).collect() == [(0, 1, 1, 64 * 128)]


def test_query_equals_sql(spark):
    assert_same(spark, "/root/testdata/sf0.001", T.op10_exact_top_k, T.ORACLE)
