"""Byte-level BPE by overlapping chunk encoding, and decoding (operator 2).

Matching the pre-token pattern is sequential: where a match begins depends on all before it.
Here every text is cut into chunks that overlap their neighbours.  Each chunk is pre-tokenised on
its own; inside each overlap the two neighbours' pre-token starts are compared, and the text is
stitched where they resynchronise at a position that is a boundary whatever came before (a
letter or digit followed by another class of character, or any mark followed by white space).
From its stitch on, a chunk's pre-tokens are those of the whole text, so the piece between two
stitches is encoded from its chunk's pre-tokens with the rank table, and a document's identifiers
are the pieces' in order.  An overlap without such a position yields no stitch: its neighbours are
pre-tokenised together.

Chunks of ``CHUNK`` characters are the unit of pre-tokenisation and stitching for every text.
Texts beyond ``DEAL`` characters are first cut by the same rule into spans that are dealt over all
tasks, so one very long text is no long task; pieces of spans are then encoded as any text is.

Identifiers are kept as a binary of little-endian unsigned 32-bit integers.  Decoding looks up
each identifier's bytes and concatenates them, so it gives back the exact UTF-8 bytes of the text.

Defined results: null and empty texts have no identifiers and decode to no bytes; special-token
strings in a text are ordinary text; repeated rows give repeated rows; an empty table gives no
rows; extra columns are ignored unless named in ``keep``, where a name of an output column is an
error; an identifier outside the table fails the decode.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from codelore.llm.common import batch, fresh, in_batches, partitions, row_batches, table
from codelore.llm.token_counts import vocabulary_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters in a chunk, in the overlap on either side of it, and in a span that is dealt.
CHUNK, OVERLAP, DEAL = 1024, 64, 32_768
#: Remembered pre-tokens per worker, and the longest that is remembered.
CACHE_WORDS, CACHE_CHARS = 200_000, 32
#: How far past its end a pre-token match can look (a contraction needs two characters).
LOOK = 3


class _Known(dict):
    """Identifiers by pre-token, as little-endian bytes; bounded."""

    def __init__(self, encoding: tiktoken.Encoding):
        super().__init__()
        self.single = encoding._encode_single_piece

    def __missing__(self, token: str) -> bytes:
        ids = np.asarray(self.single(token), dtype="<u4").tobytes()
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[token] = ids
        return ids


class RankTable:
    """A rank file with its pre-token pattern."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        if self.pattern.groups:
            raise ValueError("a pre-token pattern may not capture")
        self.known = _Known(self.encoding)
        self.bytes_of: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token

    def pieces(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
        """The pre-tokens of ``text``, piece by piece: stitched from overlapping chunks."""
        if len(text) <= chunk:
            yield self.pattern.findall(text)
            return
        # The chunk at hand: where its piece begins and it ends, its pre-tokens and their starts.
        begin, end = 0, min(len(text), chunk + overlap)
        tokens, starts = self._matched(text, 0, end)
        while end < len(text):
            low = end - 2 * overlap
            next_end = min(len(text), end + chunk)
            next_tokens, next_starts = self._matched(text, low, next_end)
            # Certain starts of both chunks, inside their overlap and clear of both ends.
            sure = [p for p in next_starts[bisect_left(next_starts, low + 1) : bisect_left(next_starts, end - LOOK)] if certain(text[p - 1], text[p])]
            mine = set(starts[bisect_left(starts, low) :])
            stitch = next((p for p in sure if p in mine and p > begin), None)
            if stitch is None:  # no resynchronisation: one chunk, twice as long at least
                end = min(len(text), max(next_end, 2 * end - begin))
                tokens, starts = self._matched(text, begin, end)
                continue
            yield tokens[bisect_left(starts, begin) : bisect_left(starts, stitch)]
            end, tokens, starts, begin = next_end, next_tokens, next_starts, stitch
        yield tokens[bisect_left(starts, begin) :]

    def _matched(self, text: str, start: int, end: int) -> tuple[list[str], list[int]]:
        """Pre-tokens of ``text[start:end]`` and their starts in ``text``."""
        part = text[start:end]
        tokens = self.pattern.findall(part)
        starts = list(accumulate(map(len, tokens), initial=start))
        if starts.pop() != end:  # a pattern that leaves characters out
            found = list(self.pattern.finditer(part))
            tokens, starts = [m[0] for m in found], [start + m.start() for m in found]
        return tokens, starts

    def encode(self, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        if not text:
            return b""
        known = self.known
        return b"".join([known[token] for piece in self.pieces(text, chunk, overlap) for token in piece])

    def decode(self, ids: bytes | None) -> bytes:
        at = self.bytes_of
        try:
            return b"".join([at[i] for i in np.frombuffer(ids or b"", dtype="<u4").tolist()])
        except (IndexError, TypeError) as error:
            raise ValueError("an identifier is not in the rank table") from error

    def starts(self, text: str, final: bool) -> list[int]:
        """Pre-token starts in ``text`` that do not depend on what follows it."""
        last = len(text) if final else len(text) - LOOK
        return [m.start() for m in self.pattern.finditer(text) if m.start() <= last]


_LETTER, _DIGIT, _SPACE = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s")


def _kind(char: str) -> str:
    return "l" if _LETTER.match(char) else "d" if _DIGIT.match(char) else "s" if _SPACE.match(char) else "p"


def certain(before: str, after: str) -> bool:
    """Whether every tokenisation has a boundary between these two characters."""
    x, y = _kind(before), _kind(after)
    return (x in "ld" and y != x) or (x == "p" and y == "s")


def chunks_of(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str, bool]]:
    """(number, start, text with overlaps, whether it is the last) of each chunk."""
    count = max(1, -(-len(text) // chunk))
    for k in range(count):
        start, end = max(0, k * chunk - overlap), min(len(text), (k + 1) * chunk + overlap)
        yield k, start, text[start:end], k == count - 1


def overlap_starts(table_: RankTable, k: int, start: int, text: str, final: bool, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Certain pre-token starts of one chunk near its head and near its tail, in text positions."""
    head, tail = k * chunk + overlap, (k + 1) * chunk - overlap
    found = [p for p in table_.starts(text, final) if 0 < p < len(text)]
    sure = [p + start for p in found if (p + start < head or p + start >= tail) and certain(text[p - 1], text[p])]
    return [p for p in sure if p < head], [p for p in sure if p >= tail]


_LOADED: dict[tuple[int, str], RankTable] = {}


def _table(data: bytes, pattern: str) -> RankTable:
    key = (hash(data), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = RankTable(data, pattern)
    return _LOADED[key]


def _sent(spark: SparkSession, vocabulary: str | None):
    return spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or public_tokenizers.path(VOCABULARY)))


def _mapped(df: DataFrame, column: str, outputs: list[tuple[str, str, pa.DataType]], make) -> DataFrame:
    """Replace ``column`` by the outputs of ``make(values)``; the other columns pass through."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != column] + [f"`{n}` {t}" for n, t, _ in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            kept = [i for i in range(b.num_columns) if i != at]
            out = pa.schema([b.schema.field(i) for i in kept] + [pa.field(n, t) for n, _, t in outputs])
            yield batch(out, [b.column(i) for i in kept] + make(b.column(at)))

    return in_batches(df, run, schema)


def encode(
    df: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    deal: int = DEAL,
    decoded: bool = False,
) -> DataFrame:
    """``keep`` columns plus ``ids`` (binary, little-endian uint32), one row per input row.

    ``decoded`` adds the binary column ``decoded``, decoded from ``ids`` in the same pass.
    """
    if min(chunk, deal) <= 2 * overlap or overlap <= 2 * LOOK:
        raise ValueError("a chunk must be longer than its two overlaps, and an overlap than what a match looks at")
    if taken := {"ids", "decoded"} & {c.lower() for c in keep}:
        raise ValueError(f"output columns among those to keep: {sorted(taken)}")
    sent = _sent(df.sparkSession, vocabulary)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    body = fresh(df, "_body")
    rows = df.select(*keep, text.alias(body))
    outputs = [("ids", "binary", pa.binary())] + [("decoded", "binary", pa.binary())] * decoded

    def encoded(values: pa.Array) -> list:
        ranks = _table(sent.value, pattern)
        ids = [ranks.encode(v.as_py(), chunk, overlap) for v in values]
        return [ids] + [[ranks.decode(x) for x in ids]] * decoded

    short = _mapped(rows.where(F.char_length(body) <= deal), body, outputs, encoded)
    long = _encode_dealt(rows.where(F.char_length(body) > deal), body, keep, sent, pattern, deal, chunk, overlap, decoded)
    return short.unionByName(long)


def _encode_dealt(rows: DataFrame, body: str, keep: tuple[str, ...], sent, pattern: str, deal: int, chunk: int, overlap: int, decoded: bool) -> DataFrame:
    """Texts of several spans; each step's rows are spans or pieces, spread over all tasks."""
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), F.struct(*keep).alias("_keep"), body)
    kept_type = numbered.schema["_keep"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.schema([b.schema.field(0), b.schema.field(1), ("k", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("part", pa.string()), ("last", pa.bool_())])
            for i in range(b.num_rows):
                whole = b.column(2)[i].as_py()
                parts = ((b.column(0)[i].as_py(), b.column(1)[i].as_py(), k, start, len(whole), part, last) for k, start, part, last in chunks_of(whole, deal, overlap))
                yield from row_batches(parts, out, 64)

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _table(sent.value, pattern)
        for b in batches:
            k, start, part, last = (b.column(i).to_pylist() for i in (2, 3, 5, 6))
            found = [overlap_starts(ranks, *x, deal, overlap) for x in zip(k, start, part, last, strict=True)]
            out = pa.schema([b.schema.field(i) for i in range(6)] + [("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])
            yield batch(out, [b.column(i) for i in range(6)] + [[x for x, _ in found], [x for _, x in found]])

    base = f"_row long, _keep {kept_type}, k long, start long, n long, part string"
    spread = partitions(rows.sparkSession)
    chunks = in_batches(numbered, cut, f"{base}, last boolean").repartition(spread, "_row", "k")
    starts = in_batches(chunks, pretokenise, f"{base}, head array<long>, tail array<long>")
    in_order = W.partitionBy("_row").orderBy("k")
    stitch = F.array_min(F.array_intersect("head", F.lag("tail").over(in_order)))
    cuts = starts.withColumn("cut", F.when(F.col("k") == 0, F.lit(0)).otherwise(stitch))
    own_start = F.coalesce(F.col("cut"), F.col("k") * deal)
    own_end = F.coalesce(F.lead("cut").over(in_order), F.least(F.col("n"), (F.col("k") + 1) * deal))
    pieces = (
        cuts.withColumn("piece", F.count("cut").over(in_order))
        .withColumn("_from", own_start)
        .withColumn("_to", own_end)
        .select("_row", "_keep", "piece", "k", F.substring("part", F.col("_from") - F.col("start") + 1, F.col("_to") - F.col("_from")).alias("part"))
        .groupBy("_row", "_keep", "piece")
        .agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))
        .select("_row", "_keep", "piece", F.array_join(F.col("parts.part"), "").alias("body"))
    )
    encoded = _mapped(pieces, "body", [("ids", "binary", pa.binary())], lambda values: [[_table(sent.value, pattern).encode(v.as_py(), chunk, overlap) for v in values]])
    gathered = encoded.groupBy("_row", "_keep").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))

    def whole(values: pa.Array) -> list:
        ids = [b"".join(v.as_py()) for v in values]
        return [ids] + [[_table(sent.value, pattern).decode(x) for x in ids]] * decoded

    outputs = [("ids", "binary", pa.binary())] + [("decoded", "binary", pa.binary())] * decoded
    joined = _mapped(gathered.select("_row", "_keep", F.col("pieces.ids").alias("parts")), "parts", outputs, whole)
    return joined.select("_keep.*", *[name for name, _, _ in outputs])


def decode(
    df: DataFrame,
    ids_col: str = "ids",
    keep: tuple[str, ...] = ("doc_id",),
    vocabulary: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``keep`` columns plus ``decoded`` (binary): the identifiers' bytes in order."""
    sent = _sent(df.sparkSession, vocabulary)
    rows = df.select(*keep, F.col(ids_col).alias("_ids"))
    return _mapped(rows, "_ids", [("decoded", "binary", pa.binary())], lambda values: [[_table(sent.value, pattern).decode(v.as_py()) for v in values]])


def digests(df: DataFrame) -> DataFrame:
    """``doc_id`` with the number and SHA-256 of identifiers and the SHA-256 of decoded bytes."""
    return encode(df, decoded=True).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLES: dict[str, str] = {}
