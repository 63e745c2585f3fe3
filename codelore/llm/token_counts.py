"""Token counts by heap-and-linked-list byte-pair merging (operator 9).

The vocabulary is a byte-pair piece model with byte fallback.  A text becomes one symbol per
character; the adjacent pair of the lowest rank (highest score, leftmost on ties) is merged
until none is left.  Only the *number* of remaining symbols matters, so the count is initial
symbols minus merges, plus the extra bytes of characters that fall back to bytes.  No token
identifiers are produced.

Two facts that are checked against the vocabulary when it is loaded keep this cheap without
changing a count: no piece has a word mark after another character, so merges never cross the
start of a word; and a character that is part of no longer piece never merges.  Words are
therefore counted independently and a bounded dictionary remembers recent ones.

Defined results: null and empty texts have 0 tokens; repeated rows give repeated rows; control
strings such as ``</s>`` inside a text are ordinary characters; of equal ranks the leftmost pair
merges first; very long texts are counted whole, a word at a time; an empty table gives no rows;
extra columns are ignored unless named in ``keep``, where a name of an output column is an error.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.llm.common import batch, fresh, in_batches, table

VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Largest vocabulary file that is sent to the workers.
MAX_VOCABULARY_BYTES = 64 << 20
#: Remembered words per worker, and the longest word that is remembered.
CACHE_WORDS, CACHE_CHARS = 200_000, 48
MARK = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Ranks and normaliser settings of a serialized piece model."""

    NORMAL, USER_DEFINED, UNUSED, BYTE = 1, 4, 5, 6

    def __init__(self, data: bytes):
        scores: dict[str, float] = {}
        self.add_prefix, self.strip_spaces, self.escape = True, True, True
        byte_pieces, normaliser, kind_of_model = 0, "", 1
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, self.NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                if kind in (self.USER_DEFINED, self.UNUSED):
                    raise ValueError("pieces that are user-defined or unused are not supported")
                byte_pieces += kind == self.BYTE
                if kind == self.NORMAL:
                    scores[piece] = score
            elif number == 2:
                for n, v in _fields(value):
                    kind_of_model = v if n == 3 else kind_of_model
            elif number == 3:
                for n, v in _fields(value):
                    if n == 1:
                        normaliser = v.decode()
                    elif n == 3:
                        self.add_prefix = bool(v)
                    elif n == 4:
                        self.strip_spaces = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
        if kind_of_model != 2 or byte_pieces != 256 or normaliser != "identity" or self.strip_spaces or not self.escape:
            raise ValueError("only byte-pair models with byte fallback and identity normalisation are supported")
        order = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank: dict[str, int] = {piece: order[x] for piece, x in scores.items()}
        self.merging = {c for piece in self.rank if len(piece) > 1 for c in piece}
        self.words_apart = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.rank)
        self.characters_known = self.merging <= self.rank.keys()
        self._known: dict[str, int] = {}

    def merged_length(self, text: str) -> int:
        """Symbols of ``text`` left when no adjacent pair is a piece."""
        rank, n = self.rank, len(text)
        if n > 1 and not self.merging.issuperset(text):
            # Characters that never merge split the text into independent runs.
            total, start = 0, 0
            for i, c in enumerate(text):
                if c not in self.merging:
                    total += self.merged_length(text[start:i]) + self._cost(c)
                    start = i + 1
            return total + self.merged_length(text[start:])
        if n <= 1:
            return self._cost(text) if n else 0
        get = self.rank.get
        # rank of the pair that starts at each symbol (-1: none), and the symbols on its sides
        pair = [get(text[i : i + 2], -1) for i in range(n)]
        pair[-1] = -1
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        left = n
        while heap:
            r, i = divmod(heappop(heap), n)
            if pair[i] != r:
                continue  # one side was merged since
            middle = after[i]
            after[i] = end = after[middle]
            pair[middle] = -1
            left -= 1
            if end < n:
                before[end] = i
                pair[i] = r = get(text[i : after[end]], -1)
                if r >= 0:
                    heappush(heap, r * n + i)
            else:
                pair[i] = -1
            b = before[i]
            if b >= 0:
                pair[b] = r = get(text[b:end], -1)
                if r >= 0:
                    heappush(heap, r * n + b)
        if self.characters_known:
            return left
        i = 0
        while i < n:  # a single symbol outside the vocabulary falls back to its bytes
            if after[i] - i == 1 and text[i] not in self.rank:
                left += len(text[i].encode()) - 1
            i = after[i]
        return left

    def _cost(self, char: str) -> int:
        return 1 if char in self.rank else len(char.encode("utf-8", "surrogatepass"))

    def _word(self, word: str) -> int:
        count = self._known.get(word)
        if count is None:
            count = self.merged_length(word)
            if len(word) <= CACHE_CHARS:
                if len(self._known) >= CACHE_WORDS:
                    self._known.clear()
                self._known[word] = count
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if self.add_prefix:
            text = MARK + text
        if not self.words_apart:
            return self.merged_length(text)
        first, *words = text.split(MARK)
        known, word = self._known, self._word
        total, run = (word(first) if first else 0), 1
        for w in words:
            if not w:
                run += 1
            elif run == 1:
                key = MARK + w
                c = known.get(key)
                total += word(key) if c is None else c
            else:
                total += word(MARK * run + w)
                run = 1
        return total + (word(MARK * (run - 1)) if run > 1 else 0)


_LOADED: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(data)
    return _LOADED[key]


def vocabulary_bytes(path: str, most: int = MAX_VOCABULARY_BYTES) -> bytes:
    """A vocabulary file's bytes, refused beyond the size that may be sent to every worker."""
    with open(path, "rb") as file:
        data = file.read(most + 1)
    if len(data) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return data


def count_tokens(
    df: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    vocabulary: str | None = None,
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """``keep`` columns plus ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row.

    Null texts count as empty.  The model file's bytes are broadcast; their size is fixed by
    the vocabulary and checked, not by the corpus.
    """
    if taken := {"n_bytes", "n_tokens", "over_limit"} & {c.lower() for c in keep}:
        raise ValueError(f"output columns among those to keep: {sorted(taken)}")
    spark, body = df.sparkSession, fresh(df, "_text")
    sent = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary or public_tokenizers.path(VOCABULARY)))
    source = df.select(
        *keep,
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).cast("string").alias(body),
    )
    fields = [f for f in source.schema.fields if f.name != body]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value)
        for b in batches:
            at = b.schema.get_field_index(body)
            counts = [model.count(t.as_py()) for t in b.column(at)]
            kept = [i for i in range(b.num_columns) if i != at]
            out = pa.schema([b.schema.field(i) for i in kept] + [pa.field("n_tokens", pa.int64())])
            yield batch(out, [b.column(i) for i in kept] + [counts])

    return in_batches(source, counted, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
