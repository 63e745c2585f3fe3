"""Benchmark decontamination by training suffix arrays (operator 7).

Every Arrow batch of documents is one training shard.  Its words become identifiers of the
benchmark's vocabulary (0: any other word, and the gap between documents), and its suffixes are
sorted into a suffix array, as deep as a test suffix reaches or up to the first word that no test
text has.  Suffixes whose first two words stand side by side in no test text are left out before
sorting: nothing of two or more words matches there.

Every suffix of every test text is binary-searched in the array.  The places that begin with its
window are a range of the array; each is compared onward to the end of its verbatim match.  Shorter
matches are found beside the places where test suffixes fall: the longest match of a training
suffix with any test suffix is that with the nearest one before or after it.  Shards are searched
independently, so nothing is gathered.

The test side is sent to every shard.  It is read in blocks whose size in words is bounded
(``MAX_TEST_WORDS``); a larger benchmark takes a pass for each block, one after another, whose
matches are written to the shared folder before the next block is read, and merged by row.

Defined results: A-Z are lower-cased, words are runs of ASCII letters and digits and of any
non-ASCII characters; a window is 8 consecutive words of an item, or a shorter item whole; items
without words, null texts and null item ids match nothing; equal item ids count once; null and
empty documents have no words; the longest match has at least two words or is a whole item of one,
else its length is 0; of equally long ones the first in the document counts, with one of the
items that match there; repeated rows give repeated rows; very long texts are searched whole; empty
tables give no rows or no matches; extra columns pass only if kept, where a name of an output
column is an error.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.llm.common import batch, fresh, in_batches, materialise, table

WINDOW = 8
#: Items with windows in a document from which it counts as contaminated.
LEAST_ITEMS = 2
#: Words of test text in one block, and so in one broadcast.
MAX_TEST_WORDS = 2_000_000
#: Words in the shortest match that is reported besides windows.
LEAST_MATCH = 2
#: Places that are compared onward at once.
_PLACES = 1 << 15

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | str | None) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


class TestBlock(NamedTuple):
    """What a shard needs of a block of test items."""

    items: list  # item ids
    texts: list[bytes]  # their words, space-joined


class TestSuffixes:
    """Every suffix of a block of items, the windows among them, and where each occurs."""

    def __init__(self, block: TestBlock, window: int):
        self.window = window
        split = [t.split() for t in block.texts]
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        lengths = np.array([len(ws) for ws in split], dtype=np.int64)
        gap = max(window, 2)
        starts = np.cumsum(lengths + gap) - (lengths + gap)
        flat = np.zeros(int(lengths.sum()) + gap * (len(split) + 1), dtype=np.uint32)
        for start, ws in zip(starts.tolist(), split, strict=True):
            flat[start : start + len(ws)] = [self.vocabulary[w] for w in ws]
        self.flat, self.longest = flat, int(lengths.max(initial=0))
        # All suffixes, in the order of their first words.
        every = np.flatnonzero(flat)
        self.keys = _keys(flat, every, window)
        order = np.argsort(self.keys, kind="stable")
        self.suffixes, self.keys = every[order], self.keys[order]
        item_at = np.repeat(np.arange(len(split)), lengths)
        self.suffix_item = item_at[order]
        # Windows: eight words of an item, or an item of fewer.
        ends = (starts + lengths)[item_at]
        whole = (every == starts[item_at]) & (lengths[item_at] < window)
        of = np.flatnonzero((ends - every >= window) | whole)
        self.at, self.item_of, self.item_end = every[of], item_at[of], ends[of]
        self.size = np.minimum(lengths, window)[self.item_of]
        # Words that are a window, and pairs of words that a training suffix must begin with.
        self.single = np.zeros(len(self.vocabulary) + 1, dtype=bool)
        self.single[flat[self.at[self.size == 1]]] = True
        self.bits = 22
        self.pairs = np.zeros(1 << self.bits, dtype=bool)
        two = every[flat[every + 1] > 0]
        self.pairs[self.pair(flat[two], flat[two + 1])] = True

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)


def _keys(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` words from each place as byte strings that sort like the word sequences."""
    rows = words[at[:, None] + np.arange(width)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * width}").ravel() if len(at) else np.zeros(0, dtype=f"S{4 * width}")


class Shard:
    """The suffix array of one shard's words, as far as suffixes can match."""

    def __init__(self, texts: list[bytes | None], test: TestSuffixes):
        get, gap = test.vocabulary.get, max(test.window, 2)
        ids = array("I")
        lengths = []
        blank = array("I", [0] * gap)
        for text in texts:
            words = words_of(text)
            ids.extend([get(w, 0) for w in words])
            ids.extend(blank)
            lengths.append(len(words))
        self.lengths = np.array(lengths, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + gap)])[:-1] if lengths else np.zeros(0, dtype=np.int64)
        self.words = np.frombuffer(ids, dtype=np.uint32) if lengths else np.zeros(0, dtype=np.uint32)
        self.test = test
        here = np.flatnonzero(self.words)
        here = here[test.pairs[test.pair(self.words[here], self.words[here + 1])] | test.single[self.words[here]]]
        keys = _keys(self.words, here, test.window)
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.sorted = here[order], keys[order]
        self._deepen()

    def _deepen(self) -> None:
        """Order suffixes of equal first words by the words after, as far as a test suffix reaches."""
        width, depth = self.test.window, self.test.window
        same = np.flatnonzero(self.sorted[1:] == self.sorted[:-1])
        tied = np.unique(np.concatenate([same, same + 1]))
        group = np.cumsum(np.concatenate([[True], self.sorted[1:] != self.sorted[:-1]]))[tied] if len(tied) else tied
        while len(tied) and depth < self.test.longest:
            # Beyond a word that no test text has, no test suffix reaches.
            open_ = (self.words[self.suffixes[tied][:, None] + np.arange(depth - width, depth)] > 0).all(axis=1)
            tied, group = tied[open_], group[open_]
            if not len(tied):
                return
            keys = _keys(self.words, self.suffixes[tied] + depth, width)
            order = np.lexsort((keys, group))
            # Members of a group are equal so far: they change places among themselves.
            self.suffixes[tied] = self.suffixes[tied][order]
            keys, group = keys[order], group[order]
            again = (keys[1:] == keys[:-1]) & (group[1:] == group[:-1])
            member = np.concatenate([again, [False]]) | np.concatenate([[False], again])
            group = np.cumsum(np.concatenate([[True], ~again]))[member]
            tied = tied[member]
            depth += width

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, test suffix) of every training suffix: its longest match within a window's
        length, which is that with the test suffix just before or just after it.
        """
        t = self.test
        if not len(self.suffixes) or not len(t.suffixes):
            return np.zeros(len(self.suffixes), dtype=np.int64), np.zeros(len(self.suffixes), dtype=np.int64)
        falls = np.searchsorted(self.sorted, t.keys, "left")  # of every test suffix
        after = np.searchsorted(falls, np.arange(len(self.suffixes)), "right")
        sides = [np.clip(after - 1, 0, len(t.suffixes) - 1), np.clip(after, 0, len(t.suffixes) - 1)]
        lengths = []
        for side in sides:
            going = np.ones(len(self.suffixes), dtype=bool)
            length = np.zeros(len(self.suffixes), dtype=np.int64)
            for k in range(t.window):
                word = self.words[self.suffixes + k]
                going &= (word > 0) & (word == t.flat[t.suffixes[side] + k])
                length += going
            lengths.append(length)
        first = lengths[0] >= lengths[1]
        return np.where(first, lengths[0], lengths[1]), np.where(first, sides[0], sides[1])

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, test window, words matched) of every occurrence of every test window."""
        t = self.test
        if not len(self.suffixes) or not len(t.at):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        keys = _keys(t.flat, t.at, t.window)
        low = np.searchsorted(self.sorted, keys, "left")
        high = np.searchsorted(self.sorted, keys, "right")
        for size in np.unique(t.size[t.size < t.window]).tolist():
            # A short item's window: every suffix that begins with its words.
            short = np.flatnonzero(t.size == size)
            top = np.full((len(short), t.window), 0xFFFFFFFF, dtype=">u4")
            top[:, :size] = t.flat[t.at[short][:, None] + np.arange(size)]
            high[short] = np.searchsorted(self.sorted, top.view(f"S{4 * t.window}").ravel(), "right")
        counts = high - low
        window = np.repeat(np.arange(len(t.at)), counts)
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        place = self.suffixes[np.repeat(low, counts) + within]
        return place, window, self._onward(place, window)

    def _onward(self, place: np.ndarray, window: np.ndarray) -> np.ndarray:
        t, out = self.test, self.test.size[window].copy()
        end = len(self.words)
        for s in range(0, len(place), _PLACES):
            p, w = place[s : s + _PLACES], window[s : s + _PLACES]
            length = out[s : s + _PLACES]
            going = np.arange(len(p))
            while len(going):
                a, b = p[going] + length[going], t.at[w[going]] + length[going]
                inside = (a < end) & (b < t.item_end[w[going]])
                going, a, b = going[inside], a[inside], b[inside]
                going = going[self.words[a] == t.flat[b]]
                length[going] += 1
        return out

    def by_document(self) -> list[tuple]:
        """(words, hit spans, items, longest match, its item, its place) of each document."""
        t, n = self.test, len(self.lengths)
        place, window, length = self.matches()
        out = [(int(x), [], [], 0, None, None) for x in self.lengths]
        spans: dict[int, list] = {}
        items: dict[int, list] = {}
        if len(place):
            doc = np.searchsorted(self.starts, place, "right") - 1
            mark = np.zeros(len(self.words) + 1, dtype=np.int32)
            np.add.at(mark, place, 1)
            np.add.at(mark, place + t.size[window], -1)
            hit = np.cumsum(mark)[:-1] > 0
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            span_doc = np.searchsorted(self.starts, begin, "right") - 1
            pairs = np.unique(np.stack([doc, t.item_of[window]]), axis=1)
            for d, x, y in zip(span_doc.tolist(), begin.tolist(), stop.tolist(), strict=True):
                at = int(self.starts[d])
                spans.setdefault(d, []).append({"start": x - at, "end": y - at})
            for d, i in pairs.T.tolist():
                items.setdefault(d, []).append(i)
        # Longest matches: those of windows, and shorter ones beside test suffixes.
        short, beside = self.nearest()
        known = np.flatnonzero((short >= LEAST_MATCH) & (short < t.window))
        where = np.concatenate([place, self.suffixes[known]])
        size = np.concatenate([length, short[known]])
        item = np.concatenate([t.item_of[window], t.suffix_item[beside[known]]])
        if len(where):
            of = np.searchsorted(self.starts, where, "right") - 1
            best = np.lexsort((item, where, -size, of))
            best = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])]
            for k in best.tolist():
                d = int(of[k])
                out[d] = (int(self.lengths[d]), spans.get(d, []), items.get(d, []), int(size[k]), int(item[k]), int(where[k] - self.starts[d]))
        return out


_LOADED: dict[tuple, TestSuffixes] = {}


def _suffixes(sent, window: int) -> TestSuffixes:
    key = (hash(tuple(sent.value.texts)), hash(tuple(sent.value.items)), window)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TestSuffixes(sent.value, window)
    return _LOADED[key]


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = MAX_TEST_WORDS) -> Iterator[TestBlock]:
    """The benchmark's items in blocks of bounded size, one partition at a time on the driver."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).cast("string")).distinct()
    items, texts, held = [], [], 0
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        if held and held + len(words) > most:
            yield TestBlock(items, texts)
            items, texts, held = [], [], 0
        items.append(item)
        texts.append(b" ".join(words))
        held += len(words)
    yield TestBlock(items, texts)


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_test_words: int = MAX_TEST_WORDS,
) -> DataFrame:
    """``keep`` columns and, per row: ``n_words``, ``n_hit``, ``hits`` (word spans inside windows),
    ``items`` (ids with occurring windows), and the longest verbatim match ``longest`` in words
    with its ``longest_item`` and its word place ``longest_at``.
    """
    if taken := {"n_words", "n_hit", "hits", "items", "longest", "longest_item", "longest_at"} & {c.lower() for c in keep}:
        raise ValueError(f"output columns among those to keep: {sorted(taken)}")
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType.simpleString()
    body, row = fresh(docs, "_body"), fresh(docs, "_row")
    text = F.col(text_col).cast("string").cast("binary").alias(body)
    found = f"n_words long, hits array<struct<start:long,end:long>>, items array<{item_type}>, longest long, longest_item {item_type}, longest_at long"

    def searched(rows: DataFrame, sent) -> DataFrame:
        """The columns of ``rows`` but the last, the text, and what one block finds in it."""
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + [found])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            test = _suffixes(sent, window)
            names, kind = sent.value.items, pa.array(sent.value.items).type if sent.value.items else pa.int64()
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for b in batches:
                last = b.num_columns - 1
                each = Shard(b.column(last).to_pylist(), test).by_document()
                out = pa.schema([b.schema.field(i) for i in range(last)] + [("n_words", pa.int64()), ("hits", span), ("items", pa.list_(kind)), ("longest", pa.int64()), ("longest_item", kind), ("longest_at", pa.int64())])
                named = [(n, hits, [names[i] for i in items], most, None if item is None else names[item], at) for n, hits, items, most, item, at in each]
                yield batch(out, [b.column(i) for i in range(last)] + [list(c) for c in zip(*named, strict=True)] if named else [b.column(i) for i in range(last)] + [[]] * 6)

        return in_batches(rows, run, schema)

    blocks = test_blocks(benchmark, item_col, item_text_col, max_test_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        result = searched(docs.select(*keep, text), spark.sparkContext.broadcast(first))
    else:
        # Rows get numbers that hold over all passes; one block at a time is in memory.
        numbered = materialise(docs.select(F.monotonically_increasing_id().alias(row), *keep, text))
        passes = []
        for k, block in enumerate(chain((first, second), blocks)):
            sent = spark.sparkContext.broadcast(block)
            more = searched(numbered.select(row, body), sent)
            passes.append(materialise(more if k == 0 else more.where("longest > 0")))
            sent.destroy()
        best = F.max_by(F.struct("longest", "longest_item", "longest_at"), F.struct("longest", -F.col("longest_at"))).alias("best")
        merged = reduce(DataFrame.unionByName, passes).groupBy(row).agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"), best)
        joined = F.aggregate(
            F.array_sort("hits"),
            F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
            lambda acc, x: F.when(
                (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
                F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
            ).otherwise(F.concat(acc, F.array(x))),
        )
        own = merged.select(F.col(row), "n_words", joined.alias("hits"), "items", F.col("best.longest"), F.col("best.longest_item"), F.col("best.longest_at"))
        result = numbered.drop(body).join(own, row).drop(row)
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return result.select(*keep, "n_words", covered.alias("n_hit"), "hits", F.array_distinct("items").alias("items"), "longest", "longest_item", "longest_at")


def contaminated(least: int = LEAST_ITEMS):
    return F.size("items") >= F.lit(least)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = LEAST_ITEMS, **more) -> DataFrame:
    """The rows of ``docs`` in which windows of fewer than ``least`` items occur."""
    names = [fresh(docs, f"_c{i}") for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    text = names[docs.columns.index(text_col)]
    found = find_matches(renamed, benchmark, tuple(names), text, **more).where(~contaminated(least))
    return found.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


#: Words with their places, then windows joined by their text; each window length on its own.
ORACLE = r"""
with doc_words as (
  select doc_id, row_number() over () as r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null),
item_windows as (
  select distinct item_id, least(len(w), 8) as n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from item_words where len(w) > 0)),
sizes as (select distinct n from item_windows),
doc_windows as (
  select r, n, i, array_to_string(w[i : i + n - 1], ' ') as t
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from doc_words, sizes where len(w) >= n)),
found as (select d.r, d.i, d.n, x.item_id from doc_windows d join item_windows x on d.n = x.n and d.t = x.t),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from found) group by r),
per_item as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as names from (select distinct r, item_id from found) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from doc_words left join hit using (r) left join per_item using (r)
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES: dict[str, str] = {"op7_decontaminate": ORACLE}
