"""SimHash near-duplicates by deletion-variant signatures (operator 6).

A fingerprint has 64 bits and two texts are linked at 3 or fewer differing bits.  Cut into only
two segments, a linked pair has one segment that differs by at most one bit.  Every distinct
fingerprint is therefore indexed, for each segment, by the exact segment and by its 32
one-wildcard variants (one bit deleted): segments within one bit share an index key, whatever
the other segment holds.  Rows of equal key meet by one equality shuffle and are verified on all
64 bits.  Under an exact key all members are compared; under a wildcard key only members that
differ in the deleted bit, so no pair is looked at twice under one segment.

A key's members never become pairs in the plan: the task that holds them returns a spanning
forest of their verified links, at most one row per member.  Keys with many members are known
from counts of exact segments (taken before the variants are made); their members are dealt
into blocks, and each pair of blocks is its own group on its own task.

Components come from alternating large-star and small-star steps on the forest edges, with a
reliable checkpoint after each round.  The root of a large component is one key of these joins:
their sides are dealt by the joins themselves, so adaptive execution splits such a key over tasks,
and the minima of a key are combined before they are shuffled.

Defined results: words are split by ASCII white space after lower-casing A-Z; a text without
words (null, empty, blank) has fingerprint zero and links like any other; a text of fewer words
than a shingle is one shingle; repeated rows get equal results; a null id gets its group's
smallest non-null id, or null if there is none; extra columns pass only if named.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from codelore.llm.common import batch, fresh, in_batches, materialise, partitions, table

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Members of a key beyond which they are dealt into blocks of about this size.
BLOCK = 2048
SEGMENT_BITS = 32
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= shingle:
        pieces = iter([body])
    else:
        ends = list(accumulate(map(len, words)))
        pieces = (body[(ends[i - 1] + i if i else 0) : ends[i + shingle - 1] + i + shingle - 1] for i in range(len(words) - shingle + 1))
    total, count, digest = np.zeros(64, dtype=np.int64), 0, xxhash.xxh64_intdigest
    while True:
        hashes = np.fromiter((digest(p, seed) for p in islice(pieces, _HASHES_AT_ONCE)), dtype=">u8")
        if not len(hashes):
            break
        count += len(hashes)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns plus the fingerprint as a signed long; ``text_col`` may be kept too."""
    body = fresh(df, "_body")
    rows = df.select(*keep, F.col(text_col).cast("string").cast("binary").alias(body))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            values = np.array([fingerprint(v.as_py(), shingle) for v in b.column(last)], dtype=np.uint64).view(np.int64)
            out = pa.schema([b.schema.field(i) for i in range(last)] + [pa.field(name, pa.int64())])
            yield batch(out, [b.column(i) for i in range(last)] + [pa.array(values)])

    return in_batches(rows, run, schema)


def hexadecimal(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _segments(fps: DataFrame) -> DataFrame:
    return fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("val")), F.struct(F.lit(1).alias("seg"), F.expr("fp & 4294967295L").alias("val")))).alias("s")).select("fp", "s.seg", "s.val")


def _signatures(fps: DataFrame, block: int) -> DataFrame:
    """(key, bi, bj, b, side, fp): each fingerprint under its 66 keys, hot keys by block pairs.

    ``key`` holds the segment, the deleted bit (0: none) and the segment without that bit.
    """
    segments = _segments(fps)
    hot = materialise(segments.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > block))
    # What each segment value needs to know: the hot members under its exact and wildcard keys.
    around = hot.select("seg", "n", F.col("val").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS))).alias("bit")).select(
        "seg", "n", "bit", F.explode(F.expr("if(bit = 0, array(of), array(of, of ^ shiftleft(1L, bit - 1)))")).alias("val")
    )
    known = around.groupBy("seg", "val", "bit").agg(F.sum("n").alias("n")).groupBy("seg", "val").agg(F.map_from_entries(F.collect_list(F.struct("bit", "n"))).alias("hot"))
    told = segments.join(known, ["seg", "val"], "left")
    variants = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_BITS))).alias("bit")).select(
        "fp",
        F.expr("shiftleft(cast(seg * 33 + bit as bigint), 32) | if(bit = 0, val, val & ~shiftleft(1L, bit - 1))").alias("key"),
        F.expr("cast(if(bit = 0, 0, shiftright(val, bit - 1) & 1) as int)").alias("side"),
        F.expr(f"cast(if(hot is null, 1, ceil(coalesce(element_at(hot, bit), 1) / {block})) as int)").alias("blocks"),
    )
    cold = variants.where("blocks = 1").selectExpr("key", "0 as bi", "0 as bj", "0 as b", "side", "fp")
    dealt = variants.where("blocks > 1").selectExpr("key", "cast(pmod(xxhash64(fp), blocks) as int) as b", "side", "fp", "explode(sequence(0, blocks - 1)) as c")
    return cold.unionByName(dealt.selectExpr("key", "least(b, c) as bi", "greatest(b, c) as bj", "b", "side", "fp"))


def _differing(x: np.ndarray, y) -> np.ndarray:
    # Bits are counted unsigned: numpy takes the absolute value of signed integers.
    return np.bitwise_count(np.bitwise_xor(x, y).view(np.uint64))


def group_forest(fps: np.ndarray, sides: np.ndarray, blocks: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the links of one key's members.

    Members link if they differ by at most ``most`` bits and, where the key has two sides or two
    blocks, stand on different ones.
    """
    n = len(fps)
    two_sides, two_blocks = sides.min() != sides.max(), blocks.min() != blocks.max()
    waiting = np.ones(n, dtype=bool)
    edges: list[tuple[int, int]] = []
    for root in range(n):
        if not waiting[root]:
            continue
        waiting[root] = False
        stack = [root]
        while stack:
            i = stack.pop()
            rest = np.flatnonzero(waiting)
            if not len(rest):
                return edges
            near = _differing(fps[rest], fps[i]) <= most
            if two_sides:
                near &= sides[rest] != sides[i]
            if two_blocks:
                near &= blocks[rest] != blocks[i]
            found = rest[near]
            waiting[found] = False
            edges.extend((i, int(j)) for j in found)
            stack.extend(found.tolist())
    return edges


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links_of(columns: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Edges (u, v) among complete groups; columns: key, bi, bj, b, side, fp in key order."""
    key, bi, bj, b, side, fp = columns
    change = np.flatnonzero((key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
    starts = np.concatenate([[0], change])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    wild = (key[starts] >> 32) % 33 != 0
    out = []
    i = starts[sizes == 2]
    if len(i):
        ok = (_differing(fp[i], fp[i + 1]) <= most) & (~wild[sizes == 2] | (side[i] != side[i + 1])) & ((bi[i] == bj[i]) | (b[i] != b[i + 1]))
        out.append(np.stack([fp[i][ok], fp[i + 1][ok]]))
    for s, n, w in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), wild[sizes > 2].tolist(), strict=True):
        at = slice(s, s + n)
        sides, blocks = side[at], b[at]
        if (w and sides.min() == sides.max()) or (bi[s] != bj[s] and blocks.min() == blocks.max()):
            continue
        edges = group_forest(fp[at], sides if w else np.zeros(n, int), blocks if bi[s] != bj[s] else np.zeros(n, int), most)
        if edges:
            e = np.array(edges).T + s
            out.append(np.stack([fp[e[0]], fp[e[1]]]))
    return out


def links(fps: DataFrame, block: int = BLOCK, most: int = MOST_BITS) -> DataFrame:
    """(u, v) with u < v: links whose components are those of all links of distinct ``fp``."""
    if most > 3:
        raise ValueError("two segments with one wildcard find links of up to 3 bits")
    signatures = _signatures(fps, block)
    keys = ["key", "bi", "bj"]
    dealt = signatures.repartition(4 * partitions(fps.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def edges(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for e in _links_of(columns, most):
                if e.shape[1]:
                    yield batch(_EDGE, [pa.array(e.min(axis=0)), pa.array(e.max(axis=0))])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in (b.schema.get_field_index(n) for n in ("key", "bi", "bj", "b", "side", "fp"))]
            held = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            last = held[0].size - 1
            same = (held[0] == held[0][last]) & (held[1] == held[1][last]) & (held[2] == held[2][last])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from edges([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from edges(held)

    return in_batches(dealt, run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (u, v) that is not its component's smallest node."""
    current = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state, n = None, current.count()
    while True:
        # Large star: every larger neighbour of a node links to the node's smallest neighbour.
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = materialise(small, n)  # a round does not add edges
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((id, fp) of every row, (fp, root, first, component_id) of every distinct fingerprint).

    ``first`` is the smallest id of the fingerprint, ``component_id`` of its component.
    """
    rows = materialise(fingerprints(df, text_col, (id_col,), shingle=shingle))
    fps = materialise(rows.groupBy("fp").agg(F.min(id_col).alias("first")), rows.count())
    roots = components(links(fps.select("fp"), block))
    labelled = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, labelled.join(smallest, "root").select("fp", "root", "first", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` and ``component_id``."""
    rows, labelled = groups(df, id_col, text_col, shingle, block)
    return rows.join(labelled.select("fp", "component_id"), "fp").select(id_col, hexadecimal("fp").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` with one document of each component: the one with the smallest id.

    Rows repeated under one id and fingerprint count as one document and one of them stays.
    """
    _, labelled = groups(df, id_col, text_col, shingle, block)
    # One representative per component: the fingerprint of its smallest id (smallest on a tie).
    chosen = labelled.where(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("fp"), F.first("component_id").alias("component_id"))
    fp, key = fresh(df, "_fp"), fresh(df, "_key")
    # The id as text, so that a null id has a key too and texts are dealt once, for join and window.
    marked = fingerprints(df, text_col, tuple(df.columns), fp, shingle).withColumn(key, F.to_json(F.struct(F.col(id_col).alias("id"))))
    stay = chosen.select(F.col("fp").alias(fp), F.to_json(F.struct(F.col("component_id").alias("id"))).alias(key))
    kept = marked.join(stay, [fp, key], "left_semi")
    number = fresh(df, "_number")
    one = W.partitionBy(fp, key).orderBy(F.lit(0))
    return kept.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).select(*df.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
