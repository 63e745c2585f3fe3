"""Hybrid retrieval: a stored BM25 index, exact vector neighbours, fusion, reranking, evaluation.

Inputs and outputs are DataFrames, and many questions are answered by one plan.  The corpus is
tokenised once, when its index is built; a search reads the postings of its terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from codelore.functions import paths
from codelore.functions.text import overlap_ratio, path_tokens, relevance, search_tokens
from codelore.session import materialise

K1, B = 1.5, 0.75
#: Candidates of a channel, and how many times as many are read before filters.
POOL, OVERFETCH = 25, 4
#: Vectors or documents in a shard, and queries that are compared with it at once.
SHARD, QUERY_BLOCK = 8192, 512
#: Tokens from which a shard of the index is full, whatever the number of its documents.
SHARD_TOKENS = 2_000_000
#: Weighed terms of questions that are sent to the postings, and terms that are named to the scan.
MOST_SENT, MOST_NAMED = 50_000, 500
#: Weights of the linear reranker: vector, keyword, symbol, path, chunk type, path prior.
WEIGHTS = {"vector": 1.0, "keyword": 0.9, "symbol": 0.6, "path": 0.45, "type": 0.35, "prior": 0.5}
TYPE_PRIORS = {"method": 1.0, "function": 1.0, "class": 0.95, "block": 0.7, "module": 0.55}
OTHER_PRIOR = 0.75

Ranker = Callable[[DataFrame], DataFrame]


class Index(NamedTuple):
    """Postings (shard, term, ids, tfs, lengths), terms (term, df, tf), and the number and mean length
    of the documents, which are read when the index is opened.

    A shard is some documents; a row is what one of its terms has in them: the ids, how often each
    has the term, and how many tokens each has.
    """

    postings: DataFrame
    terms: DataFrame
    n: int
    mean: float


def term_counts(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, tf, length) of every document; documents without tokens have no rows."""
    listed = docs.select(F.col(id_col), tokens.alias("tokens"))
    return listed.select(id_col, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def totals(docs: DataFrame, tokens: Callable[[Column], Column] = search_tokens, text_col: str = "text") -> DataFrame:
    """(n, mean): the number of documents and their mean number of tokens, without an index."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text_col)))).alias("mean"))


def _inverted(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, tokens) of a partition as shards of postings.

    The row of no term has in ``n`` the number of the shard's documents, in ``total`` their tokens,
    and in ``tfs`` how many have a text.
    """
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("ids", pa.list_(kind)), ("tfs", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))])

    def shard(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, listed = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
        lengths = np.asarray(listed.value_lengths().fill_null(0), dtype="i8")
        told = len(listed) - listed.null_count
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([number], [None], [len(listed)], [int(lengths.sum())], [[]], [[told]], [[]]), schema.types, strict=True)], schema=schema)
        words = listed.flatten().dictionary_encode()
        names = words.dictionary
        order = pc.sort_indices(names)  # terms of a shard are written in their order
        place = np.empty(len(names), "i8")
        place[np.asarray(order)] = np.arange(len(names))
        pairs, tfs = np.unique(place[np.asarray(words.indices)] * len(lengths) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
        term, doc = np.divmod(pairs, max(1, len(lengths)))
        n = np.bincount(term, minlength=len(names))
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        total = np.bincount(term, tfs, len(names)).astype("i8")
        lists = [pa.ListArray.from_arrays(ends, v) for v in (ids.take(pa.array(doc)), pa.array(tfs, pa.int32()), pa.array(lengths[doc], pa.int32()))]
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(names), number)), names.take(order), pa.array(n, pa.int64()), pa.array(total), *lists], schema=schema)
        for at in range(0, len(rows), 10_000):
            yield rows.slice(at, 10_000)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= SHARD or sum(len(x.column(1).flatten()) for x in held) >= SHARD_TOKENS:
                yield from shard(number, held)
                number, held = number + 1, []
        if held:
            yield from shard(number, held)

    return invert


def build_index(docs: DataFrame, path: str, tokens: Callable[[Column], Column] = search_tokens, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Write the index of ``docs``, whose ids are unique, below ``path`` and open it.

    Documents are counted where they are read, and stay there as shards of the postings, so only
    the numbers of each term are shuffled.  A shard's terms are sorted, so a search for some terms
    reads the pages that hold them.
    """
    spark = docs.sparkSession
    listed = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))
    kind = listed.schema["id"].dataType
    counted = listed.mapInArrow(_inverted(to_arrow_type(kind)), f"shard long, term string, n long, total long, ids array<{kind.simpleString()}>, tfs array<int>, lengths array<int>")
    counted.write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("tf")).write.mode("overwrite").parquet(f"{path}/terms")
    told = F.sum(F.element_at("tfs", 1))
    stored.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.when(told > 0, F.sum("total") / told).alias("mean")).write.mode("overwrite").parquet(f"{path}/totals")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    n, mean = spark.read.parquet(f"{path}/totals").first()
    return Index(spark.read.parquet(f"{path}/postings").select("shard", "term", "ids", "tfs", "lengths"), spark.read.parquet(f"{path}/terms"), n, mean or 0.0)


def bm25(index: Index, queries: DataFrame, tokens: Callable[[Column], Column] = search_tokens, k: int | None = 5) -> DataFrame:
    """(query, id, score, rank) of the ``k`` best documents for each (query, text) by Okapi BM25.

    Repeated query terms add up; ties go to the smaller id.  The weighed terms of a bounded number of
    questions are sent to the postings: each shard adds up the scores of its documents and answers
    with its ``k`` best for each question.  More are joined with the postings.
    """
    asked = queries.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    known = asked.join(index.terms.select("term", "df"), "term")
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = known.select("query", "term", (F.col("times") * idf * (K1 + 1)).alias("weight"))
    few = weighed.limit(MOST_SENT + 1).collect()
    if len(few) <= MOST_SENT:  # a checked size: a posting is read where it lies, and shuffled once at most
        scored = _scored(index, few, queries.schema["query"].dataType, k)
    else:
        norm = K1 * (1 - B + B * F.col("length") / F.lit(index.mean))
        each = index.postings.join(weighed, "term").select("query", "weight", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p")).select("query", "weight", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))
        parts = each.select("query", "id", (F.col("weight") * F.col("tf") / (F.col("tf") + norm)).alias("part"))
        scored = parts.groupBy("query", "id").agg(F.sum("part").alias("score"))
    scored = scored.select("query", "id", F.round("score", 6).alias("score"))
    if k is None:
        return scored
    best = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _scored(index: Index, few: list, kind: DataType, k: int | None) -> DataFrame:
    """(query, id, score) of each shard's documents for weighed terms, the ``k`` best of a shard."""
    spark, mean, asked = index.postings.sparkSession, index.mean, sorted({r.query for r in few}, key=lambda q: (q is None, q))
    place, names, blocks = {q: i for i, q in enumerate(asked)}, {r.term for r in few}, {}
    for r in few:  # questions are scored in blocks, each term with those that have it
        at, of = divmod(place[r.query], QUERY_BLOCK)
        blocks.setdefault(at, {}).setdefault(r.term, []).append((of, r.weight))
    blocks = {at: {t: tuple(map(np.array, zip(*qs, strict=True))) for t, qs in terms.items()} for at, terms in blocks.items()}
    sent = spark.sparkContext.broadcast((blocks, asked))
    id_kind = index.postings.schema["ids"].dataType.elementType
    schema = pa.schema([("query", to_arrow_type(kind)), ("id", to_arrow_type(id_kind)), ("score", pa.float64())])

    def score(shard: pa.Table) -> pa.Table:
        blocks, asked = sent.value
        shard = shard.combine_chunks().sort_by("term")  # sums do not depend on the order of arrival
        flat = [pa.concat_arrays(shard.column(c).chunks).flatten() for c in ("ids", "tfs", "lengths")]
        encoded = flat[0].dictionary_encode("encode")
        ids, doc = encoded.dictionary, np.asarray(encoded.indices)
        tf, length = (np.asarray(x, dtype="f8") for x in flat[1:])
        weight = tf / (tf + K1 * (1 - B + B * length / mean))
        rank = np.empty(len(ids), "i8")
        rank[np.asarray(pc.sort_indices(ids, null_placement="at_start"))] = np.arange(len(ids))
        ends = np.cumsum(np.asarray(pa.concat_arrays(shard.column("ids").chunks).value_lengths()))
        spans = list(zip(shard.column("term").to_pylist(), np.concatenate([[0], ends[:-1]]), ends, strict=True))
        found = []
        for at, terms in blocks.items():
            sums = np.zeros((min(QUERY_BLOCK, len(asked) - at * QUERY_BLOCK), len(ids)))
            for term, start, end in spans:
                if term in terms:
                    of, weights = terms[term]
                    sums[np.ix_(of, doc[start:end])] += np.outer(weights, weight[start:end])
            for q, values in enumerate(sums):
                some = np.flatnonzero(values)
                if k is not None and len(some) > k:
                    value = -np.round(values[some], 6)
                    some = some[value <= np.partition(value, k - 1)[k - 1]]
                    some = some[np.lexsort((rank[some], -np.round(values[some], 6)))[:k]]
                if len(some):
                    found.append((np.full(len(some), at * QUERY_BLOCK + q), some, values[some]))
        if not found:
            return schema.empty_table()
        query, some, values = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table([pa.array(asked, schema.types[0]).take(pa.array(query)), ids.take(pa.array(some)), pa.array(values)], schema=schema)

    postings = index.postings.where(F.col("term").isin(*names)) if 0 < len(names) <= MOST_NAMED else index.postings
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in sorted(names)], "term string"))
    return postings.join(wanted, "term", "left_semi").groupBy("shard").applyInArrow(score, f"query {kind.simpleString()}, id {id_kind.simpleString()}, score double")


def _l2(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return ((vectors - query) ** 2).sum(axis=1)


def _cosine(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return vectors @ query / np.sqrt((vectors * vectors).sum(axis=1) * (query @ query))


MEASURES = {"l2": (_l2, True), "cosine": (_cosine, False)}


def _packed(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per key group: ids and components of its vectors as binaries."""
    columns = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def pack(data: pa.Table) -> pa.Table:
        out = {k: data.column(k).slice(0, 1) for k in keys}
        ids = np.asarray(data.column("id"), dtype="<i8")
        flat = np.concatenate([np.asarray(c.flatten(), dtype="<f8") for c in data.column("v").chunks])
        return pa.table(out | {"ids": pa.array([ids.tobytes()]), "body": pa.array([flat.tobytes()])})

    return df.select(*keys, "id", "v").groupBy(*keys).applyInArrow(pack, f"{columns}, ids binary, body binary")


def nearest(vectors: DataFrame, queries: DataFrame, measure: str = "l2", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = QUERY_BLOCK, among: bool = True) -> DataFrame:
    """(query, id, value, rank) of the ``k`` best vectors for each (query, q).

    Queries are ``among`` the vectors, and no candidates for themselves, or come from elsewhere.

    ``measure`` is squared L2 distance (least first) or cosine similarity (largest first), in
    double precision.  Vectors of another length than the query's are no candidates, nor are null ones.

    Up to ``block`` queries are sent to the vectors, which are scanned where they lie.  More are
    streamed in blocks past shards of vectors, each of which is sent once.  Either way a part of the
    vectors answers with its ``k`` best for each query.
    """
    compare, ascending = MEASURES[measure]
    slim = lambda df, i, v: df.where(F.col(i).isNotNull() & F.col(v).isNotNull()).select(F.col(i).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v")).withColumn("dims", F.size("v")).where("dims > 0")
    held, asked = slim(vectors, id_col, vector_col), slim(queries, "query", "q").distinct()
    best = W.partitionBy("query").orderBy(F.col("value").asc() if ascending else F.col("value").desc(), "id")
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("value", pa.float64())])

    def closest(ids: np.ndarray, values: np.ndarray, query: int, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """The ``k`` best of vectors that are sorted by their ids."""
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.round(compare(values, q), 6) + 0.0
        ranked = np.argsort(value if ascending else -value, kind="stable")[: k + 1]  # ties by id
        ranked = ranked[ids[ranked] != query][:k] if among else ranked[:k]
        return np.full(len(ranked), query), ids[ranked], value[ranked]

    few = asked.select("id", "v").limit(block + 1).collect()
    if len(few) <= block:
        sent = held.sparkSession.sparkContext.broadcast([(r.id, np.array(r.v)) for r in few])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, flat, sizes = np.asarray(b.column(0)), np.asarray(b.column(1).flatten()), np.asarray(b.column(1).value_lengths())
                starts = np.cumsum(sizes) - sizes
                for dims in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dims)
                    rows = rows[np.argsort(ids[rows], kind="stable")]
                    values = flat[starts[rows][:, None] + np.arange(dims)]
                    found = [closest(ids[rows], values, query, q) for query, q in sent.value if len(q) == dims]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)

        near = held.select("id", "v").mapInArrow(scan, "query long, id long, value double")
        return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    held, asked = materialise(held), materialise(asked)
    shards, blocks = max(1, -(-held.count() // shard)), max(1, -(-asked.count() // block))
    deal = lambda df, name, n: _packed(df.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")), ["dims", name])
    one = deal(held, "shard", shards).select("dims", "shard", F.lit(-1).alias("block"), "ids", "body")
    many = materialise(deal(asked, "block", blocks)).select("dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "ids", "body")
    units = one.unionByName(many).repartition(min(shards, 4 * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "dims", "shard").sortWithinPartitions("dims", "shard", "block")
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(b.column(i)[r] for i in range(5)) for b in batches for r in range(b.num_rows))
        for (dims, _), unit in groupby(rows, key=lambda r: (r[0].as_py(), r[1].as_py())):
            own = None
            for _, _, at, ids, body in unit:
                numbers = np.frombuffer(ids.as_py(), "<i8")
                values = np.frombuffer(body.as_py(), "<f8").reshape(-1, dims)
                if at.as_py() < 0:
                    order = np.argsort(numbers, kind="stable")
                    own = numbers[order], values[order]
                    continue
                if own is None:
                    continue
                found = [closest(*own, query, q) for query, q in zip(numbers.tolist(), values, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=schema)

    answers = units.mapInArrow(search, "query long, id long, value double")
    return answers.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def min_max(df: DataFrame, value: str, *pool: str, name: str = "scaled") -> DataFrame:
    """``value`` scaled to 0..1 within each pool; a flat pool is 1 if positive, else 0."""
    over = W.partitionBy(*pool)
    low, high = F.min(value).over(over), F.max(value).over(over)
    flat = F.when(high > 0, 1.0).otherwise(0.0)
    return df.withColumn(name, F.when(high - low < 1e-12, flat).otherwise((F.col(value) - low) / (high - low)))


def fuse(dense: DataFrame, sparse: DataFrame, keys: list[str], dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """Full outer union of two scored channels; a missing score is 0."""
    joined = dense.join(sparse, keys, "full_outer").na.fill(0.0, ["vector_score", "keyword_score"])
    return joined.withColumn("score", F.round(dense_weight * F.col("vector_score") + sparse_weight * F.col("keyword_score"), 6))


def hybrid(index: Index, vectors: DataFrame, questions: DataFrame, k: int = 5, tokens: Callable[[Column], Column] = search_tokens, condition: Column | None = None, chunks: DataFrame | None = None, **columns: str) -> DataFrame:
    """(query, id, vector_score, keyword_score, score) of the candidates of both channels.

    ``questions`` has (query, text, q).  Each channel has its ``max(POOL, k)`` best; scores are scaled
    to 0..1 within a question's channel.  A ``condition`` on ``chunks`` (id, ...) narrows the vectors
    before their search, and the keyword channel after four times as many were read, so it may have
    fewer.  Keyword statistics are always those of the whole corpus.
    """
    pool = max(POOL, k)
    fits = None if condition is None else chunks.where(condition).select("id")
    own = columns.get("id_col", "vec_id")
    reachable = vectors if fits is None else vectors.join(fits.withColumnRenamed("id", own), own, "left_semi")
    near = nearest(reachable, questions.select("query", "q"), "l2", pool, among=False, **columns)
    dense = min_max(near.withColumn("raw", relevance(F.col("value"))), "raw", "query", name="vector_score").select("query", "id", F.round("vector_score", 6).alias("vector_score"))
    found = bm25(index, questions.select("query", "text"), tokens, pool if fits is None else OVERFETCH * pool)
    if fits is not None:
        kept = found.join(fits, "id", "left_semi").drop("rank")
        found = kept.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= pool)
    sparse = min_max(found, "score", "query", name="keyword_score").select("query", "id", F.round("keyword_score", 6).alias("keyword_score"))
    return fuse(dense, sparse, ["query", "id"])


def features(candidates: DataFrame, chunks: DataFrame, questions: DataFrame, tokens: Callable[[Column], Column] = search_tokens) -> DataFrame:
    """Candidates with what the linear reranker reads: ``symbol_overlap``, ``path_overlap``,
    ``chunk_type`` and ``path_prior``.  ``chunks`` has (id, relative_path, symbol, chunk_type).
    """
    asked = questions.select("query", tokens(F.col("text")).alias("_terms"))
    of = candidates.join(chunks.select("id", "relative_path", "symbol", "chunk_type"), "id").join(asked, "query")
    return of.withColumns(
        {
            "symbol_overlap": overlap_ratio(F.col("_terms"), search_tokens(F.coalesce("symbol", F.lit("")))),
            "path_overlap": overlap_ratio(F.col("_terms"), path_tokens(F.col("relative_path"))),
            "path_prior": paths.prior(F.col("relative_path")),
        }
    ).drop("_terms")


def rerank(candidates: DataFrame) -> DataFrame:
    """``rerank_score`` from vector_score, keyword_score, symbol_overlap, path_overlap, chunk_type
    and path_prior: the linear reranker.
    """
    kind = F.lit(OTHER_PRIOR)
    for name, prior in TYPE_PRIORS.items():
        kind = F.when(F.col("chunk_type") == name, F.lit(prior)).otherwise(kind)
    w = WEIGHTS
    total = (
        w["vector"] * F.col("vector_score") + w["keyword"] * F.col("keyword_score") + w["symbol"] * F.col("symbol_overlap")
        + w["path"] * F.col("path_overlap") + w["type"] * kind + w["prior"] * F.col("path_prior")
    )
    return candidates.withColumn("rerank_score", F.round(total, 9))


def fusion_only(candidates: DataFrame) -> DataFrame:
    """``rerank_score`` from the two channels alone: the control of the reranker."""
    return candidates.withColumn("rerank_score", F.round(F.col("vector_score") + F.col("keyword_score"), 6))


def search(index: Index, vectors: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = 5, ranker: Ranker = rerank, **more) -> DataFrame:
    """(query, rank, id, ...) of the ``k`` best chunks for each question, ranked by any ``ranker``.

    A ranker takes candidates with their features and adds ``rerank_score``.
    """
    candidates = hybrid(index, vectors, questions, k, chunks=chunks, **more)
    scored = ranker(features(candidates, chunks, questions))
    best = W.partitionBy("query").orderBy(F.desc("rerank_score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def median_latency(timed: DataFrame, ms_col: str = "ms") -> DataFrame:
    """One row: the median of the milliseconds that questions took, to one place."""
    return timed.agg(F.bround(F.percentile(ms_col, 0.5), 1).alias("median_ms"))


def evaluation(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, query: str = "query", item: str = "id") -> DataFrame:
    """hit@5, hit@50, mean reciprocal rank (a miss counts 0) and the median rank that was found."""
    first = ranked.join(relevant, item, "left_semi").groupBy(query).agg(F.min("rank").alias("found"))
    every = queries.select(query).distinct().join(first, query, "left")
    return every.agg(
        F.sum(F.when(F.col("found") <= 5, 1).otherwise(0)).cast("long").alias("hit_5"),
        F.sum(F.when(F.col("found") <= 50, 1).otherwise(0)).cast("long").alias("hit_50"),
        F.round(F.avg(F.coalesce(1 / F.col("found"), F.lit(0.0))), 6).alias("mrr"),
        F.percentile("found", 0.5).alias("median_rank"),
    )

