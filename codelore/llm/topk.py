"""Exact top-k inner-product search by the threshold algorithm (operator 10).

Candidates are dealt into shards of bounded size.  A shard holds, for every dimension, the list of
its vectors in order of that component.  A query walks all lists at once, from the end that its
component's sign favours: vectors met for the first time are scored in full (random access), and
the walk ends when the bound, the sum over dimensions of query component times the list's
current component, falls below the k-th best score.  A bound equal to it goes on, because an
unseen vector of the same score may have a smaller id.  Shards answer independently; a query's
answer is the best k of the shards' answers.

Every shard is sent once, followed by the blocks of queries in a stream; its task sorts the lists
once and answers block after block, so neither side is ever held whole.  Equal vectors of a shard
are scored once and keep only the rows that can be answers (2k of the smallest ids), so a
very common vector costs no more than a rare one.

Scores are exact integers: single or double precision is used where every partial sum is known to
fit its mantissa, 64-bit integers where they fit, and Python's integers beyond.

Defined results: a component x becomes floor(scale * x), x as double; vectors that are null, empty,
or hold a null or non-finite component take no part, nor do rows with a null id; vectors of
another length than the query's are no candidates for it; rows that carry the query's id are its
own; a query row that is repeated is one query, and rows of one query id with different vectors
share its k places; every candidate row counts, repeated ones each; ties go to the smaller id;
scores beyond a long are ranked exactly and returned as the nearest long; empty tables give no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from codelore.llm.common import batch, in_batches, materialise, partitions, table

K, SCALE, QUERY_STEP = 20, 64, 20
#: Vectors in a shard, queries in a block, and list entries read before the first look at the
#: bound; every further look comes after twice as many.
SHARD, QUERIES_AT_ONCE, DEPTH = 4096, 512, 64

_ANSWER = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("above", pa.string())])


def participants(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part; v: array of double components as they are."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite
    return df.where(sound).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def quantised(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: 64-bit integers, or Python's where those do not fit."""
    with np.errstate(over="ignore"):
        whole = np.floor(values * float(scale))
    if not whole.size or np.abs(whole).max() < 2.0**62:
        return whole.astype(np.int64)
    # A double of this size is an integer, and so is its product.
    exact = [int(w) if np.isfinite(w) else int(x) * scale for w, x in zip(whole.ravel().tolist(), values.ravel().tolist(), strict=True)]
    return np.array(exact, dtype=object).reshape(values.shape)


class Lists:
    """A shard's distinct vectors with their ids, and one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        # Vectors in order of their components, whatever the type of these.
        ranks = vectors if vectors.dtype != object else np.stack([np.unique(c, return_inverse=True)[1] for c in vectors.T], axis=1)
        order = np.lexsort((ids, *ranks.T[::-1]))
        ids, vectors, ranks = ids[order], vectors[order], ranks[order]
        new = np.concatenate([[True], (ranks[1:] != ranks[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        # k rows of an id are enough, and 2k rows in all: k are left when the query's own are passed over.
        first_id = np.concatenate([[True], (ids[1:] != ids[:-1]) | new[1:]])
        able = np.arange(len(ids)) - np.flatnonzero(first_id)[np.cumsum(first_id) - 1] < k
        ids, group = ids[able], group[able]
        start = np.searchsorted(group, np.arange(int(new.sum())))
        able = np.arange(len(ids)) - start[group] < 2 * k
        self.ids, self.k = ids[able], k
        self.start = np.searchsorted(group[able], np.arange(int(new.sum()) + 1))
        self.vectors, ranks = vectors[new], ranks[new]
        self.largest = int(np.abs(self.vectors).max(initial=0))
        self.dims = self.vectors.shape[1]
        self.lists = np.argsort(ranks, axis=0, kind="stable").T.copy()  # per dimension, ascending
        self.ordered = np.take_along_axis(self.vectors, self.lists.T, axis=0).T.copy()
        self._held: dict[type, np.ndarray] = {}

    def _typed(self, kind: type) -> np.ndarray:
        if kind not in self._held:
            self._held[kind] = self.vectors.astype(kind)
        return self._held[kind]

    def _kind(self, query: np.ndarray) -> type:
        """The cheapest type in which every partial sum of a product with the query is exact."""
        top = self.largest * max(1, int(np.abs(query).max(initial=0))) * self.dims
        return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64 if top < 1 << 62 else object

    def top(self, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the k best by (score desc, id), and the list depth that was read."""
        n, k = len(self.vectors), self.k
        kind = self._kind(query)
        vectors, as_kind = self._typed(kind), query.astype(kind)
        whole = np.int64 if kind is not object else object
        active = np.flatnonzero(query)
        weight = query[active].astype(whole)
        unseen = np.ones(n, dtype=bool)
        groups, scores, every = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=whole), None
        rising = weight < 0  # small components first
        depth, step = 0, DEPTH
        while True:
            if not len(active) or depth + step >= n:
                met = np.flatnonzero(unseen)  # the rest of the lists
                depth = n
            else:
                now = np.zeros(n, dtype=bool)
                now[self.lists[active[rising], depth : depth + step].ravel()] = True
                now[self.lists[active[~rising], n - depth - step : n - depth].ravel()] = True
                met = np.flatnonzero(now & unseen)
                depth += step
                step = depth
            unseen[met] = False
            if len(met):
                if every is None and 2 * len(met) > n:
                    every = (vectors @ as_kind).astype(whole)  # one pass is cheaper than as many look-ups
                found = every[met] if every is not None else (vectors[met] @ as_kind).astype(whole)
                groups, scores = np.concatenate([groups, met]), np.concatenate([scores, found])
                if len(groups) > k:
                    # A group outside the k + 1 best scores, ties included, cannot hold an answer.
                    keep = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    groups, scores = groups[keep], scores[keep]
            if depth >= n:
                break
            ids, exact = self._answers(groups, scores, own)
            if len(ids) >= k:
                bound = int(self.ordered[active[rising], depth - 1] @ weight[rising]) + int(self.ordered[active[~rising], n - depth] @ weight[~rising])
                if bound < exact[-1]:
                    return ids, exact, depth
        return *self._answers(groups, scores, own), depth

    def _answers(self, groups: np.ndarray, scores: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        counts = self.start[groups + 1] - self.start[groups]
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        ids = self.ids[np.repeat(self.start[groups], counts) + within]
        scores = np.repeat(scores, counts)
        other = ids != own
        ids, scores = ids[other], scores[other]
        falling = -scores if scores.dtype != object else np.unique(-scores, return_inverse=True)[1]
        order = np.lexsort((ids, falling))[: self.k]
        return ids[order], scores[order]


def _packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key group: the group's ids and components as little-endian binaries."""
    columns = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def pack(data: pa.Table) -> pa.Table:
        vectors = data.column("v").combine_chunks()
        flat = np.asarray(vectors.flatten() if isinstance(vectors, pa.ListArray) else pa.concat_arrays(vectors.chunks).flatten(), dtype="<f8")
        out = {k: data.column(k).slice(0, 1) for k in keys}
        # Embeddings are often single precision, which is kept where it is exact.
        with np.errstate(over="ignore"):
            single = flat.astype("<f4")
        out["ids"] = pa.array([np.asarray(data.column("id"), dtype="<i8").tobytes()], pa.binary())
        out["single"] = pa.array([bool((single == flat).all())])
        out["body"] = pa.array([(single if out["single"][0].as_py() else flat).tobytes()], pa.binary())
        return pa.table(out)

    return df.select(*keys, "id", "v").groupBy(*keys).applyInArrow(pack, f"{columns}, ids binary, single boolean, body binary")


def _unpacked(dims: int, ids: bytes, single: bool, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(body, "<f4" if single else "<f8").astype(np.float64).reshape(-1, dims)


def top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = K,
    shard: int = SHARD,
    block: int = QUERIES_AT_ONCE,
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query.

    Both inputs have the columns (id, v) of :func:`participants`.
    """
    candidates, queries = materialise(candidates), materialise(queries.distinct())
    shards = max(1, -(-candidates.count() // shard))
    blocks = max(1, -(-queries.count() // block))

    def dealt(df: DataFrame, name: str, parts: int) -> DataFrame:
        # By row, so that copies of one vector or one id are spread too.
        keyed = df.withColumn("dims", F.size("v")).withColumn(name, F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
        return _packed(keyed, ["dims", name])

    held = dealt(candidates, "shard", shards).select("dims", "shard", F.lit(-1).alias("block"), "ids", "single", "body")
    asked = materialise(dealt(queries, "block", blocks)).select("dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "ids", "single", "body")
    spread = min(shards, 4 * partitions(candidates.sparkSession))
    units = held.unionByName(asked).repartition(spread, "dims", "shard").sortWithinPartitions("dims", "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(b.column(i)[r] for i in range(6)) for b in batches for r in range(b.num_rows))
        for (dims, _), unit in groupby(rows, key=lambda r: (r[0].as_py(), r[1].as_py())):
            lists = None
            for _, _, at, *packed in unit:
                ids, values = _unpacked(dims, *(x.as_py() for x in packed))
                vectors = quantised(values, scale)
                if at.as_py() < 0:
                    lists = Lists(ids, vectors, k)
                elif lists is not None:
                    parts = [(q, *lists.top(v, q)[:2]) for q, v in zip(ids.tolist(), vectors, strict=True)]
                    scores = np.concatenate([s for _, _, s in parts])
                    # Exact integers as text only where a long does not hold them.
                    above = [str(s) if not -(1 << 63) <= s < 1 << 63 else None for s in scores.tolist()] if scores.dtype == object else None
                    if scores.dtype == object:
                        scores = np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores.tolist()], dtype=np.int64)
                    yield batch(_ANSWER, [pa.array(np.repeat([q for q, _, _ in parts], [len(i) for _, i, _ in parts])), pa.array(np.concatenate([i for _, i, _ in parts])), pa.array(scores), above or pa.nulls(len(scores), pa.string())])

    answers = in_batches(units, search, "query_id long, vec_id long, score long, above string")
    # Of longer numbers the longer text is the greater, or the smaller if negative.
    digits = F.coalesce(F.length("above"), F.lit(0)) * F.when(F.col("score") < 0, -1).otherwise(1)
    text = F.when(F.col("score") >= 0, F.col("above"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc(digits), F.desc(text), F.when(F.col("score") < 0, F.col("above")), "vec_id")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = participants(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("id") % QUERY_STEP == 0))


ORACLE = """
with v as (
  select vec_id as id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select q.id as query_id, c.id as vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from (select distinct id, v from v where id % 20 = 0) q join v c on len(q.v) = len(c.v) and q.id <> c.id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

QUERIES = {"op10_exact_top_k": op10_exact_top_k}
ORACLES = {"op10_exact_top_k": ORACLE}
