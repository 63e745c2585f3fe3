"""Vectors of texts: any embedder, called on batches of bounded size, and one that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts to vectors, in order.
Embedder = Callable[[list[str]], "np.ndarray"]
DIMENSIONS, AT_ONCE = 256, 32


class Hashing:
    """A deterministic embedder: words are hashed into signed places, and vectors have length one.

    Texts that share words are near each other, the same text is always the same vector, and a text
    without words is the zero vector.
    """

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = crc32(word.encode("utf-8", "surrogatepass"))
                row[h % self.dimensions] += 1.0 if h >> 31 else -1.0
            size = float(np.linalg.norm(row))
            if size:
                row /= size
        return out


def embed(chunks: DataFrame, embedder: Embedder | None = None, text_col: str = "content", at_once: int = AT_ONCE) -> DataFrame:
    """``chunks`` with ``embedding``: ``at_once`` texts are given to the embedder at a time.

    Null texts count as empty.  All vectors must have one length; another one is an error.
    """
    call = embedder or Hashing()
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields] + ["embedding array<float>"])
    at = chunks.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = None
        for b in batches:
            for start in range(0, b.num_rows, at_once):
                part = b.slice(start, at_once)
                vectors = np.asarray(call([t or "" for t in part.column(at).to_pylist()]), dtype=np.float32)
                if vectors.ndim != 2 or len(vectors) != part.num_rows or length not in (None, vectors.shape[1]):
                    raise ValueError("an embedder gives one vector of one length for each text")
                length = vectors.shape[1]
                held = pa.array(list(vectors), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, held], names=[*part.schema.names, "embedding"])

    return chunks.mapInArrow(run, schema)


def embed_in_steps(chunks: DataFrame, write: Callable[[DataFrame], None], progress: Callable[[int, int], None] | None = None, embedder: Embedder | None = None, steps: int = 10, key: str = "id") -> int:
    """Embed and ``write`` the chunks in ``steps`` parts; ``progress`` is told (done, total) after each.

    A part that was written stays when a later one fails.  Returns the number of chunks.
    """
    total, done = chunks.count(), 0
    for step in range(min(steps, total)):
        part = chunks.where(F.pmod(F.xxhash64(key), F.lit(min(steps, total))) == step)
        write(embed(part, embedder))
        done += part.count()
        if progress:
            progress(done, total)
    return total
