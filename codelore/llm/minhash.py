"""Near-duplicates by exact Jaccard similarity of word shingles, with MinHash candidates.

Texts are linked if the sets of their 5-word shingles have a Jaccard similarity of 0.8 or more, and
one document of each linked component stays.  The pipeline's near-duplicate stage links texts by
their SimHash fingerprints as well (operator 6, all its steps): both kinds of links make one graph,
so neither method loses what only the other one finds.  Candidates of the similarity
share at least one of ``BANDS`` bands of ``ROWS`` minima; a pair at 0.8 shares none with a
probability of about 3e-6, one of higher similarity more rarely.  Every candidate is verified
on the shingles themselves, so nothing below the bound is linked.

Equal sets are one node.  Nodes of one band value form a bucket, which is never listed in one row:
buckets are counted, and of buckets with the same members, told by their number and the sums of
their hashes, one is looked at.  The task that holds a bucket's texts returns a spanning forest of
its verified links, at most one row per member.  Members of a bucket of more than ``BLOCK`` are
dealt into blocks, and each pair of blocks is its own group, so a task never holds more than two
blocks however many members a bucket has.

Defined results: words are those of the SimHash operator; a text of fewer words than a shingle is
one shingle; texts without words (null, empty, blank) are one node; shingles, sets and texts are
told apart by 64-bit hashes; rows repeated under one id and text count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window as W

from codelore.llm import simhash
from codelore.llm.common import batch, fresh, in_batches, materialise, partitions, row_batches
from codelore.llm.simhash import components

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 5
#: Members of a bucket beyond which it is dealt into blocks of about this size.
BLOCK = 512
#: Shingles whose permuted hashes are held at once.
_AT_ONCE = 1024

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    body, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(body, SEED)], dtype=np.uint64)
    ends = list(accumulate(map(len, words)))
    pieces = (body[(ends[i - 1] + i if i else 0) : ends[i + shingle - 1] + i + shingle - 1] for i in range(len(words) - shingle + 1))
    return np.unique(np.fromiter((digest(p, SEED) for p in pieces), dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A value for each band of minima of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(hashes), _AT_ONCE):
        np.minimum(least, (hashes[s : s + _AT_ONCE, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (small + large - shared)


def forest(sets: list[np.ndarray], blocks: list[int], least: float = SIMILAR) -> Iterator[tuple[int, int]]:
    """A spanning forest (index pairs) of the links of one group, across blocks if it has two."""
    two, waiting = len(set(blocks)) > 1, list(range(len(sets)))
    while waiting:
        stack = [waiting.pop()]
        while stack and waiting:
            i, rest = stack.pop(), []
            for j in waiting:
                if (not two or blocks[i] != blocks[j]) and similar(sets[i], sets[j], least):
                    yield i, j
                    stack.append(j)
                else:
                    rest.append(j)
            waiting = rest


def _signatures(texts: DataFrame, id_col: str, shingle: int, fingerprints: bool = False) -> DataFrame:
    """(id, key, node, bands, fp): the hash of each row's text and of its set, the set's bands, and
    the SimHash fingerprint of the text if it is asked for (else null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, values, fps = [], [], []
            for value in b.column(2):
                text = value.as_py()
                held = shingles(text, shingle)
                nodes.append(xxhash.xxh64_intdigest(held.tobytes(), SEED))
                values.append(bands(held).view(np.int64) if len(held) else [])
                if fingerprints:
                    fps.append(simhash.fingerprint(text))
            out = pa.schema([b.schema.field(0), b.schema.field(1), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("fp", pa.int64())])
            signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield batch(out, [b.column(0), b.column(1), signed[0], values, signed[1] if fingerprints else pa.nulls(len(nodes), pa.int64())])

    return in_batches(texts.select("id", "key", "text"), run, f"id {texts.schema['id'].dataType.simpleString()}, key long, node long, bands array<long>, fp long")


def links(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(u, v): verified links whose components are those of all links of ``nodes`` (node, key,
    bands) that share a band; ``texts`` (key, text) holds their texts.
    """
    rows = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    # Counts and sums are combined before they are shuffled, so a large bucket is no hot task.
    sums = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)]
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), *sums).where("n > 1")
    # Of the bands of a node, few are shared.
    chosen = materialise(sizes.groupBy("n", "s0", "s1").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), 4 * nodes.count())
    members = rows.join(chosen, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = members.select("bucket", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = paired.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "block", "node")
    wanted = rows.join(chosen, "bucket", "left_semi").select("node").distinct().join(nodes.select("node", "key"), "node")
    held = texts.join(wanted, "key").groupBy("node").agg(F.min("text").alias("text"))
    dealt = members.join(held, "node").select("group", "block", "node", "text").repartition(4 * partitions(nodes.sparkSession), "group").sortWithinPartitions("group", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i) for i in range(4)), strict=True))

        def found() -> Iterator[tuple[int, int]]:
            for _, same in groupby(rows, key=lambda r: r[0].as_py()):
                blocks, ids, sets = [], [], []
                for _, at, node, text in same:
                    blocks.append(at.as_py())
                    ids.append(node.as_py())
                    sets.append(shingles(text.as_py(), shingle))
                yield from ((min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in forest(sets, blocks, least))

        yield from row_batches(found(), _EDGE)

    return in_batches(dealt, run, "u long, v long").distinct()


def fingerprint_links(rows: DataFrame, bits: int) -> DataFrame:
    """(u, v): links of the nodes of ``rows`` (node, fp) whose components are those of all nodes
    with fingerprints that differ by at most ``bits`` bits.

    The smallest node of a fingerprint stands for it, and the fingerprint's other nodes link to it.
    """
    pairs = materialise(rows.select("node", "fp").distinct(), rows.count())
    fps = materialise(pairs.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), pairs.count())
    ends = [fps.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_node")) for x in ("u", "v")]
    across = simhash.links(fps.select("fp"), most=bits).join(ends[0], "u").join(ends[1], "v").select("u_node", "v_node")
    within = pairs.join(fps.where("first <> last"), "fp").where("node <> first").select("first", "node")
    # Written before texts are compared: in one job with that, an executor took more memory.
    return materialise(across.union(within).toDF("u", "v"), pairs.count())


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = SIMILAR, block: int = BLOCK, bits: int | None = None) -> DataFrame:
    """The rows of ``df`` with one document of each component: the one with the smallest id.

    With ``bits``, texts whose SimHash fingerprints differ by at most so many bits are linked too.
    """
    text = F.col(text_col).cast("string")
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    rows = materialise(_signatures(texts, id_col, shingle, bits is not None))
    nodes = materialise(rows.groupBy("node").agg(F.min("key").alias("key"), F.first("bands").alias("bands")), rows.count())
    linked = links(nodes, texts.select("key", "text"), shingle, least, block)
    if bits is not None:
        linked = linked.union(fingerprint_links(rows.select("node", "fp"), bits))
    roots = components(linked).withColumnRenamed("node", "of")
    labelled = rows.join(roots, rows.node == roots.of, "left").select("id", "key", F.coalesce("root", "node").alias("root"))
    # The smallest id that is not null, and its smallest text hash.
    chosen = labelled.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("x")).select("x.id", "x.key")
    key, name = fresh(df, "_key"), fresh(df, "_name")
    # The id as text, so that a null id has a key too.
    named = lambda c: F.to_json(F.struct(c.alias("id")))
    marked = df.select("*", F.xxhash64(text).alias(key), named(F.col(id_col)).alias(name))
    kept = marked.join(chosen.select(F.col("key").alias(key), named(F.col("id")).alias(name)), [key, name], "left_semi")
    number = fresh(df, "_number")
    one = W.partitionBy(key, name).orderBy(F.lit(0))
    return kept.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).select(*df.columns)
